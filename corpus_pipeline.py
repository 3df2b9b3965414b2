"""The training-data pipeline: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textflow.llm import common, mixing, ngram_join, pii, toxicity, wfst_pieces

log = logging.getLogger(__name__)


def _columns(names: list[str]) -> list[Column]:
    return [F.col("`" + n.replace("`", "``") + "`").alias(n) for n in names]


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns packed into one, so that no operator's column meets a column of the same name."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = F.struct(*_columns(others)) if others else F.lit(None).cast("string")
    return docs.select("doc_id", "text", packed.alias("packed_columns"))


def _together(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of before, in their order; doc_id and text as they are now."""
    inside = F.col("packed_columns")
    return df.select(*(F.col(c) if c in ("doc_id", "text") else inside[c].alias(c) for c in columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score reaches the threshold.

    Null and empty texts are scored as empty ones and stay; null ids and repeated rows are scored
    row by row; other columns pass unchanged, whatever their names; an empty table stays empty.
    """
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    clean = toxicity.score(_apart(docs), model).where(F.col("tox_score") < toxicity.THRESHOLD)
    return _together(clean, docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id in each group of copies and near copies.

    Rows without an id stay, and so does each text without words. Rows of one id are one
    document, of which the row with the smallest text stays (null texts last; ties by a hash of
    the other columns). An empty table stays empty.
    """
    groups = ngram_join.join(docs)
    keep = groups.where("doc_id = group_id").select("doc_id")
    kept = docs.join(keep, "doc_id", "left_semi").select(*docs.columns)
    if ngram_join._repeats(docs.where("doc_id IS NOT NULL")):
        first = F.struct(F.col("text").isNull().alias("none"), "text", F.xxhash64("packed_columns").alias("hash"))
        one = _apart(kept).withColumn("first", first).groupBy("doc_id")
        kept = _together(one.agg(F.min_by(F.struct("text", "packed_columns"), "first").alias("row")).select("doc_id", "row.*"), docs.columns)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows.

    Null texts stay null, empty ones empty; null ids and repeated rows are rows like all others;
    other columns pass unchanged, whatever their names; an empty table stays empty.
    """
    cand = pii.candidates(_apart(docs).withColumn("text_was_null", F.col("text").isNull()))
    found = pii.redact(pii.detect(cand, pii.fit(cand)))
    out = _together(found.withColumn("text", F.when(~F.col("text_was_null"), F.col("text"))), docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents until the languages' expected token totals meet their targets; none is dropped.

    Null and empty texts have no tokens and stay once or more, by the prior; null ids and repeated
    rows are rows like all others (equal rows get equal numbers of copies); other columns pass
    unchanged, whatever their names; an empty table stays empty.
    """
    planned, fitted = mixing.plan(_apart(docs), mixing.by_language(spark, sf_dir, docs), least=1.0)
    say = log.info if fitted["residual"] < mixing.TOLERANCE else log.warning
    say("mixing: want %s, got %s, residual %.2g", *(dict(zip(fitted["domains"], fitted[k])) for k in ("want", "got")), fitted["residual"])
    return _together(planned.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))), docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of before, then the piece ids of every text and the text that they decode to.

    Null and empty texts have no ids and decode to the empty text; null ids and repeated rows
    are rows like all others; where an added column's name is taken it ends in ``_pieces``; an
    empty table stays empty.
    """
    out = wfst_pieces.encode_documents(_apart(docs), keep=("text", "packed_columns"))
    added = [c for c in out.columns if c not in ("doc_id", "text", "packed_columns")]
    names = [c if c not in docs.columns else f"{c}_pieces" for c in added]
    inside = F.col("packed_columns")
    old = [F.col(c) if c in ("doc_id", "text") else inside[c].alias(c) for c in docs.columns]
    return out.select(*old, *(F.col(c).alias(n) for c, n in zip(added, names)))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_languages),
    ("sentencepiece", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
