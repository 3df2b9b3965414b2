"""Registering queries: a Spark function with its SQL, or one SQL text that both engines run."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs SQL whose tables are written ``@name``; each folder's tables are views of their own."""
    for name in set(re.findall(r"@(\w+)", sql)) & set(TABLES):
        view = f"tf_{zlib.crc32(sf_dir.encode()):x}_{name}"
        table(spark, sf_dir, name).createOrReplaceTempView(view)
        sql = re.sub(rf"@{name}\b", view, sql)
    return spark.sql(sql)


def shared(name: str, sql: str, duck: str | None = None) -> None:
    """A query whose SQL text (tables as ``@name``) Spark runs; DuckDB runs the same or ``duck``."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, sql)
    ORACLES[name] = re.sub(r"@(\w+)", r"\1", duck or sql)
