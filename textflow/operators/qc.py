"""Document quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import lexicon as L
from . import structure as S


def document_qc(docs: DataFrame, lexicon: DataFrame, max_len: int = 20) -> DataFrame:
    """A row a document: segment, sentence and token counts, coverage, new-word rate, sentence lengths, pending hits.

    Coverage of a text without tokens is 1 and its new-word rate 0, as in the source system.
    """
    sents = S.sentences(docs)
    length = T.word_count(F.col("sent"))
    by_sent = sents.groupBy("doc_id").agg(
        F.countDistinct("seg_idx").alias("segments"),
        F.count(F.lit(1)).alias("sentences"),
        F.avg(length).alias("avg_len"),
        F.max(length).alias("max_len"),
        F.count_if(length > max_len).alias("overlong"),
    )
    # counts by document and type first: the join with the resolved types then sees each pair once
    pairs = S.tokens(sents.select("doc_id", "sent")).groupBy("doc_id", "tok").agg(F.count(F.lit(1)).alias("n"))
    oov, pending = F.col("oov"), L.pending_forms(lexicon).withColumn("pend", F.lit(True))
    by_tok = L.mark(pairs, lexicon).join(pending, "tok", "left").groupBy("doc_id").agg(
        F.sum("n").alias("tokens"),
        (1 - F.sum(F.when(oov, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"),
        (F.count_if(oov) / F.count(F.lit(1))).alias("new_word_rate"),
        F.sum(F.when(F.coalesce("pend", F.lit(False)), F.col("n")).otherwise(0)).alias("pending_hits"),
    )
    out = by_sent.join(by_tok, "doc_id", "left")
    return out.select(
        "doc_id", "segments", "sentences", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("coverage", F.lit(1.0)).alias("coverage"),
        F.coalesce("new_word_rate", F.lit(0.0)).alias("new_word_rate"), "avg_len", "max_len", "overlong", F.coalesce("pending_hits", F.lit(0)).alias("pending_hits"),
    )
