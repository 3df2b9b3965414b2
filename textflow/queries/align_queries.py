"""Version comparison that depends on order, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align as A
from ..operators import lexicon as L
from .base import query, table
from .text_queries import versions


def _sides(spark, d):
    v = versions(spark, d).withColumn("pair", F.col("pair_id") * 1000 + F.col("turn"))
    cut = lambda c: v.select(F.col("pair").alias("pair_id"), F.posexplode_outer(T.sentence_units(F.col(c))).alias("at", "sent")).where("at IS NOT NULL")
    return cut("base"), cut("cur")


@query("ver_align")
def ver_align(spark, d):
    return A.align(*_sides(spark, d))


@query("fid_oov_attribution")
def fid_oov_attribution(spark, d):
    """Hard words of each pair's base: gone with their sentence, gone from the matched sentence, or kept."""
    base, cur = _sides(spark, d)
    return A.attribution(base, cur, L.lexicon_of(table(spark, d, "benchmark")))


@query("ver_vector_coverage")
def ver_vector_coverage(spark, d):
    # the table is read once for each side: sides that share a column lose it in cogroup
    e = lambda: table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    unit = lambda k: e().where(F.col("vec_id") % 2 == k).select(F.floor(F.col("vec_id") / 20).alias("pair_id"), F.col("vec_id").alias("at"), "v")
    return A.vector_coverage(unit(0), unit(1))


@query("agg_dossier")
def agg_dossier(spark, d):
    """Alignment summary beside the texts' sizes for each pair."""
    rows = A.align(*_sides(spark, d)).groupBy("pair_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("match", "lost", "added")), F.sum(F.size("lost_signals")).alias("signals_lost"))
    v = versions(spark, d).select((F.col("pair_id") * 1000 + F.col("turn")).alias("pair_id"), T.word_count(F.col("base")).alias("base_words"), T.word_count(F.col("cur")).alias("cur_words"))
    return v.join(rows, "pair_id", "left")
