"""Text functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import ABBREVIATIONS

_CUT = r'(?<=[.!?"] )(?<!(?:^|\s)(?i:' + ABBREVIATIONS + r")\. )(?<!(?:^|\s)(?:[A-Z]\.){1,4} )"


def register(spark: SparkSession) -> None:
    """Makes the table function ``text_sentences(text)`` known in this session: idx (from 1) and sent, as ``text.sentences`` cuts (Spark has a function ``sentences`` of its own).

    It is a SQL function, so it is planned and run like the query that calls it:
    ``SELECT d.doc_id, s.* FROM docs d, LATERAL text_sentences(d.text) s``.
    """
    parts = f"split(trim(regexp_replace(regexp_replace(body, '[>—-]+', ' '), r'\\s+', ' ')), r'{_CUT}')"
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION text_sentences(body STRING) RETURNS TABLE (idx INT, sent STRING)
RETURN SELECT pos + 1, trim(col) FROM posexplode(filter({parts}, p -> p RLIKE '[A-Za-z]{{2,}}'))"""
    )
