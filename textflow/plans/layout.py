"""How plans are laid out: broadcasts behind a check of size, salted aggregation for hot keys."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` has at most ``rows`` rows (checked by counting no further), else ``df`` as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """Deals a table out if its rows come in fewer pieces than there are cores, or most of them in a few; else it stays as it is.

    Files are cut by bytes, but a Parquet row group is read whole by the piece its middle lies in: a file of
    one row group gives one piece with all rows and many without any, so rows are counted, not pieces.
    """
    cores, pieces = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    n = df.groupBy(F.spark_partition_id()).count().agg(F.sum("count").alias("whole"), F.max("count").alias("most")).first()
    return df.repartition(max(cores, pieces)) if (n["most"] or 0) * cores > 1.2 * (n["whole"] or 0) else df


def by_key(df: DataFrame, key: str, text: str, piece: int = 2 << 20) -> DataFrame:
    """Rows of one key side by side, in pieces of about ``piece`` bytes of ``text`` however many there are.

    What is grouped by the key and more behind this is not shuffled again, and a task's groups stay few.
    """
    cores, whole = df.sparkSession.sparkContext.defaultParallelism, df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(max(cores, whole // piece), key)


def salted_collect(df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 32) -> DataFrame:
    """The first ``k`` rows of each key by ``order``; a hot key is cut down within salts first."""
    from pyspark.sql import Window

    salted = df.withColumn("__s", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    w = Window.partitionBy(*keys, "__s").orderBy(*order)
    few = salted.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return few.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__s").withColumnRenamed("__r", "rank")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and spark.sparkContext.master.startswith("local["):  # tests: driver and executors are one process
        top = "file://" + tempfile.mkdtemp(prefix="textflow-")
        spark.conf.set("spark.checkpoint.dir", top)
    if not top:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with its row number by ``order`` (from 1) as ``name``: a sort over ranges of rows, of which only the sizes are put together."""
    path = scratch(df.sparkSession, "numbered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("__range", F.shiftrightunsigned("__row", 33))
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("first")).orderBy("__range").collect()  # a row for each range
    before, shift = 0, [0] * (1 + max((r["__range"] for r in sizes), default=0))
    for r in sizes:
        shift[r["__range"]] = before - r["first"] + 1
        before += r["n"]
    table = F.from_json(F.lit(json.dumps(shift)), "array<bigint>")  # one literal in the plan
    return rows.withColumn(name, F.col("__row") + table[F.col("__range").cast("int")]).drop("__row", "__range")
