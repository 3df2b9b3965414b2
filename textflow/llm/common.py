"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir and spark.sparkContext.master.startswith("local["):  # tests: driver and executors are one process
        set_dir = "file://" + tempfile.mkdtemp(prefix="textflow-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    if not set_dir:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return set_dir.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def labelled_sample(labels: DataFrame, label: str, modulus: int, held: int, bound: int) -> DataFrame:
    """At most ``bound`` labelled doc ids whose crc32 fold may be learnt from, picked by a hash of the id.

    Returns (doc_id, label). Rows with a null id or label are left out; an id that is listed
    several times keeps its largest label.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(F.crc32(F.col("doc_id").cast("string")) % modulus != held)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def held_out(modulus: int, held: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(False))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to probabilities, by Newton steps on smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    if not len(margin) or not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = float(np.std(margin)) or 1.0
    m = margin / scale
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * m + b)
        g = np.array([np.dot(p - t, m), np.sum(p - t)])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[np.dot(w, m * m) + 1e-3, np.dot(w, m)], [np.dot(w, m), np.sum(w) + 1e-3]])
        step = np.linalg.solve(h, g)
        norm = float(np.abs(step).max())
        step *= min(1.0, 2.0 / (norm + 1e-12))
        a, b = a - step[0], b - step[1]
        if norm < 1e-7:
            break
    return a / scale, b
