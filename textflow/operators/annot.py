"""Inline annotations ``word（gloss）`` of segmented texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PATTERN = r"([A-Za-z][A-Za-z'-]*)（([^（）]{1,24})）"


def annotations(segs: DataFrame) -> DataFrame:
    """doc_id, seg_idx, n (order within the segment), word, key, parts, gloss."""
    rows = segs.select("doc_id", "seg_idx", F.posexplode_outer(F.regexp_extract_all("body", F.lit(PATTERN), F.lit(0))).alias("n", "a")).where("n IS NOT NULL")
    part = lambda i: F.regexp_extract("a", PATTERN, i)
    rows = rows.select("doc_id", "seg_idx", "n", part(1).alias("word"), part(2).alias("gloss"))
    key = T.clean_token(F.col("word"))
    return rows.select("doc_id", "seg_idx", "n", "word", key.alias("key"), F.split(key, "-").alias("parts"), "gloss")


def coverage(must: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, must, missing, coverage. A word is covered if a form of it meets a form of an annotated word or of a hyphenated part.

    must: doc_id, tok. With nothing to annotate coverage is 1.
    """
    noted = notes.select("doc_id", F.explode(F.array_union(F.array("key"), F.col("parts"))).alias("w")).select("doc_id", F.explode(T.variants(F.col("w"))).alias("form")).distinct()
    wanted = must.select("doc_id", "tok").distinct()
    got = wanted.select("doc_id", "tok", F.explode(T.variants(F.col("tok"))).alias("form")).join(noted, ["doc_id", "form"], "left_semi").select("doc_id", "tok").distinct().withColumn("ok", F.lit(True))
    j = wanted.join(got, ["doc_id", "tok"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("must"), F.count_if(F.col("ok").isNull()).alias("missing"))
    return j.withColumn("coverage", F.when(F.col("must") == 0, F.lit(1.0)).otherwise(1 - F.col("missing") / F.col("must")))


def same_gloss(a: Column, b: Column) -> Column:
    """Equal or contained glosses, marks aside; an empty one conflicts with nothing."""
    bare = lambda c: F.regexp_replace(c, r"[\s，。；、,;.()（）]", "")
    x, y = bare(a), bare(b)
    return (x == "") | (y == "") | x.contains(y) | y.contains(x)


def conflicts(notes: DataFrame) -> DataFrame:
    """doc_id, key, glosses of words with glosses that don't agree."""
    g = notes.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("gloss")).alias("glosses")).where(F.size("glosses") > 1)
    return g.where(F.exists("glosses", lambda x: ~same_gloss(x, F.col("glosses")[0])))


def duplicates(notes: DataFrame) -> DataFrame:
    """doc_id, key, n of words annotated more than once."""
    return notes.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_only(notes: DataFrame) -> DataFrame:
    """The first annotation of each word in a document."""
    return notes.groupBy("doc_id", "key").agg(F.min_by(F.struct("seg_idx", "n", "word", "gloss"), F.struct("seg_idx", "n")).alias("x")).select("doc_id", "key", "x.*")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, PATTERN, "$1")


def cjk_outside(text: Column) -> Column:
    """Chinese runs that stand outside annotations."""
    return F.regexp_extract_all(F.regexp_replace(text, r"（[^（）]*）", ""), F.lit("[一-鿿]+"), F.lit(0))
