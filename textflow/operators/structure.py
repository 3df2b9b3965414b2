"""Documents to segments, sentences and tokens.

Arrays are exploded with their empty rows, which fall away behind: Spark would work out the array
of a plain explode twice, once for a filter on its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, lang, seg_idx (from 1), body: the lines of each document that hold something."""
    return docs.select("doc_id", "lang", F.posexplode_outer(T.segments(F.col("text"))).alias("p", "body")).where("p IS NOT NULL").select("doc_id", "lang", (F.col("p") + 1).alias("seg_idx"), "body")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, lang, seg_idx, sent_idx (from 1 within the segment), sent."""
    s = segments(docs)
    return s.select("doc_id", "lang", "seg_idx", F.posexplode_outer(T.sentences(F.col("body"))).alias("p", "sent")).where("p IS NOT NULL").select("doc_id", "lang", "seg_idx", (F.col("p") + 1).alias("sent_idx"), "sent")


def words(sents: DataFrame) -> DataFrame:
    """Sentences' words as they stand: the columns that came, tok_idx (from 1), word."""
    keep = [c for c in sents.columns if c != "sent"]
    each = sents.select(*keep, F.posexplode_outer(T.raw_words(F.col("sent"))).alias("p", "word")).where("p IS NOT NULL")
    return each.select(*keep, (F.col("p") + 1).alias("tok_idx"), "word")


def tokens(sents: DataFrame) -> DataFrame:
    """Sentences' tokens: the columns that came, tok_idx (from 1), tok."""
    each = words(sents)
    return each.select(*each.columns[:-1], T.clean_token(F.col("word")).alias("tok"))  # a row each: compiled code, which a lambda over the array is not
