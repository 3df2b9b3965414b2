"""Measures of experiment cells: how well hard words are annotated, with a ledger that runs along the segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import annot as A
from . import lexicon as L


def cell_metrics(segments: DataFrame, lexicon: DataFrame) -> DataFrame:
    """cell, segments, final_segments, first_missing, gen_coverage, final_coverage, gain (percentage points), duplicate_rate.

    ``segments``: cell, ord (their order), source, first, final. A text's words that want a
    gloss are the hard ones (no form in the lexicon) of its source and its own; those that an
    earlier segment's final text has annotated are settled. Coverage is the share of the rest that
    the text annotates, summed over all segments with a final text before it is divided: 1 if
    there is nothing to annotate. A missing first text is replaced by the final one and counted.

    The ledger is the first segment in which each word's forms are annotated, so that no
    segment waits for those before it.
    """
    done = segments.where("final IS NOT NULL")
    texts = done.select("cell", "ord", "source", F.explode(F.create_map(F.lit("gen"), F.coalesce("first", "final"), F.lit("fin"), F.col("final"))).alias("kind", "text"))
    words = F.array_distinct(F.concat(F.coalesce(T.tokens(F.col("source")), F.array().cast("array<string>")), T.tokens(A.strip(F.col("text")))))
    toks = texts.select("cell", "ord", "kind", F.explode(words).alias("tok"))
    must = L.mark(toks, lexicon).where("oov").select("cell", "ord", "kind", "tok", F.explode(T.variants(F.col("tok"))).alias("form"))
    notes = A.annotations(texts.select(F.struct("cell", "kind").alias("doc_id"), F.col("ord").alias("seg_idx"), F.col("text").alias("body")))
    notes = notes.select("doc_id.cell", "doc_id.kind", F.col("seg_idx").alias("ord"), "key", "parts")
    own = notes.select("cell", "kind", "ord", F.explode(F.array_union(F.array("key"), F.col("parts"))).alias("w")).select("cell", "kind", "ord", F.explode(T.variants(F.col("w"))).alias("form")).distinct()
    ledger = notes.where("kind = 'fin'").select("cell", "ord", F.explode(T.variants(F.col("key"))).alias("form")).groupBy("cell", "form").agg(F.min("ord").alias("since"))
    told = must.join(ledger, ["cell", "form"], "left").join(own.withColumn("has", F.lit(True)), ["cell", "kind", "ord", "form"], "left")
    told = told.groupBy("cell", "kind", "ord", "tok").agg(F.min("since").alias("since"), F.max("has").alias("has")).where("since IS NULL OR since >= ord")
    sums = told.groupBy("cell").pivot("kind", ["gen", "fin"]).agg(F.count(F.lit(1)).alias("want"), F.count("has").alias("have"))
    twice = notes.where("kind = 'fin'").groupBy("cell", "ord").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys")).groupBy("cell").agg(F.sum("n").alias("notes"), F.sum(F.col("n") - F.col("keys")).alias("extra"))
    counts = segments.groupBy("cell").agg(F.count(F.lit(1)).alias("segments"), F.count("final").alias("final_segments"), F.count_if(F.col("final").isNotNull() & F.col("first").isNull()).alias("first_missing"))
    share = lambda kind: F.coalesce(F.try_divide(f"{kind}_have", f"{kind}_want"), F.lit(1.0))
    out = counts.join(sums, "cell", "left").join(twice, "cell", "left")
    return out.select("cell", "segments", "final_segments", "first_missing", share("gen").alias("gen_coverage"), share("fin").alias("final_coverage"), (100 * (share("fin") - share("gen"))).alias("gain"), F.coalesce(F.try_divide("extra", "notes"), F.lit(0.0)).alias("duplicate_rate"))
