"""Word lists, tables and ledgers from files. Schemas are declared, never inferred; bad rows come back with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: entry types of the vocabulary table that count as known, and the one that is pending
KNOWN_TYPES = ("单词", "课标词", "待定词")
PENDING_TYPE = "待定词"
COST = "ts STRING, scene STRING, book STRING, chapter STRING, provider STRING, model STRING, prompt_ver STRING, tokens_in LONG, tokens_out LONG, elapsed_ms LONG, failover STRING, result STRING"
LEDGER = ", ".join(f"{c} STRING" for c in "ts book chapter tier scene mark_type rule outcome check provider model prompt_ver original revised basis reject_reason".split())


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """word, pending of a vocabulary CSV (``词,类型,…``); other entry types are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    word, kind = (F.trim(F.col(f"`{c}`")) for c in rows.columns[:2])
    rows = rows.select(F.lower(word).alias("word"), kind.alias("kind")).where(F.col("kind").isin(*KNOWN_TYPES) & (F.col("word") != ""))
    return rows.groupBy("word").agg(F.max(F.col("kind") == PENDING_TYPE).alias("pending"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct first words of the lines ``1. word`` or ``word …``; other lines are skipped."""
    word = F.lower(F.regexp_extract("value", r"^\s*(?:\d+[.)]\s*)?([A-Za-z][A-Za-z'-]*)", 1))
    return spark.read.text(path).select(word.alias("word")).where("word <> ''").distinct()


def learned_queue(spark: SparkSession, path: str) -> DataFrame:
    """word, hits of a queue file: a word or phrase a line, or the first two CSV / TSV columns; header and comments skipped."""
    cells = F.split(F.regexp_replace("value", "^﻿", ""), "[,\t]")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.lower(F.trim(cells[0])).alias("word"), F.get(cells, F.lit(1)).try_cast("int").alias("hits"))
    return rows.where(F.col("word").rlike("^[a-z]") & ~F.col("word").isin("word", "words")).groupBy("word").agg(F.coalesce(F.max("hits"), F.lit(1)).alias("hits"))


def scaled_table(spark: SparkSession, path: str, scale: float) -> DataFrame:
    """word, value of a TSV with scaled integers (zipf x 100, age x 10); only finite values above 0."""
    rows = spark.read.csv(path, sep="\t", schema="word STRING, raw STRING")
    return rows.select(F.lower(F.trim("word")).alias("word"), (F.col("raw").try_cast("double") / scale).alias("value")).where("value > 0 AND value < double('Infinity')")


def word_grades(spark: SparkSession, path: str, low: float, high: float) -> DataFrame:
    """word, value of a JSON object word -> number, inside [low, high]."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>")).alias("word", "value"))
    return rows.where(F.col("value").between(low, high))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, gloss, source; rows without a gloss are left out."""
    rows = spark.read.csv(path, header=True, schema="word STRING, gloss STRING, source STRING", multiLine=True, escape='"')
    return rows.select(F.lower(F.trim("word")).alias("word"), F.trim("gloss").alias("gloss"), "source").where("word <> '' AND gloss <> ''")


def ledger(spark: SparkSession, path: str, schema: T.StructType, versions: tuple[int, ...] = (1,)) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a JSON-lines ledger. Rejects carry the line's text and the reason; nothing is dropped."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = rows.select("value", F.from_json("value", full, options).alias("r"))
    reason = F.when(F.col("r._bad").isNotNull() | F.col("r").isNull(), "not valid JSON").when(~F.coalesce(F.col("r.schemaVersion").isin(*versions), F.lit(False)), "unknown schemaVersion")
    parsed = parsed.withColumn("reason", reason)
    return parsed.where("reason IS NULL").select("r.*").drop("_bad"), parsed.where("reason IS NOT NULL").select("value", "reason")


def golden_labels(spark: SparkSession, path: str) -> DataFrame:
    """name, category, sentence of labelled texts (one JSON object a file)."""
    rows = spark.read.schema("name STRING, annotations MAP<STRING, ARRAY<STRING>>").json(path, multiLine=True)
    return rows.select("name", F.explode("annotations").alias("category", "sents")).select("name", "category", F.explode("sents").alias("sentence"))


def latest_tier_files(files: DataFrame) -> DataFrame:
    """(path) -> chapter, tier, path: the last file of each chapter and tier by name; working copies left out."""
    name = F.element_at(F.split("path", "/"), -1)
    tier, chapter = F.regexp_extract(name, r"([AMB])层", 1), F.regexp_extract(name, r"(\d+)", 1).try_cast("int")
    rows = files.select("path", tier.alias("tier"), chapter.alias("chapter"), name.alias("name")).where(~F.col("name").rlike(r"\.(bak|tmp)|~$") & (F.col("tier") != ""))
    return rows.groupBy("chapter", "tier").agg(F.max_by("path", "name").alias("path"))


def write_csv(df: DataFrame, path: str) -> None:
    """A table sink: quoted CSV with a header (cells keep commas, quotes and line ends)."""
    df.write.csv(path, header=True, escape='"', quoteAll=True)


def write_lines(df: DataFrame, path: str) -> None:
    """A ledger sink: a JSON object a line, null fields kept out."""
    df.write.json(path)
