"""Ledger streams: ingest with rejects and late rows, dedupe, last-writer state, windows, sessions, undo matching.

Each function takes a streaming DataFrame and a folder that all executors share, runs until
the input at hand is used up (``availableNow``) and returns the result as a batch DataFrame.
Run again on the same folder it goes on where it stopped. What a batch has to know of earlier
ones is in Spark's state store, by key, so a batch costs what it brings; results are written
as changes, a folder a batch, so that a batch that runs twice writes the same folder again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import qc

EVENTS = "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE, props STRING"
LATE = "3650 days"  # files may come in any order of time; a live feed sets a shorter bound


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", schema: str = EVENTS, files: int = 4) -> DataFrame:
    """New files of a table, ``files`` of them a batch. The table is a folder of files or a single file."""
    # a pattern that fits this one name: without one Spark takes the path for a folder's
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def _finish(df: DataFrame, folder: str, mode: str, batch: Callable[[DataFrame, int], None]) -> None:
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(batch).start()
    q.awaitTermination()


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _written(spark: SparkSession, schema: T.StructType, folder: str) -> DataFrame:
    """Rows that batches wrote to ``folder/batch=<n>``; none if no batch ran."""
    if not _there(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(folder).drop("batch")


def _changes(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs the stream and returns every row that it ever put out."""
    _finish(df, folder, mode, lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}"))
    return _written(df.sparkSession, df.schema, f"{folder}/out")


def _reason() -> Column:
    return F.when(F.col("event_id").isNull(), "no id").when(F.get_json_object("props", "$.k").isNull(), "no item id").when(F.col("value").isNull(), "no value")


def ingest(events: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason). Nothing is lost: a row is in one of the two."""
    out = _changes(events.withColumn("reason", _reason()), folder)
    return out.where("reason IS NULL").drop("reason"), out.where("reason IS NOT NULL")


def late_accounting(events: DataFrame, folder: str, late: str = LATE) -> tuple[DataFrame, DataFrame]:
    """(rows with their ``side``: accepted, rejected or late; number of rows read, by batch).

    A row is late if it lies more than ``late`` behind the newest time of all batches before
    its own. It is kept apart, not lost: over any number of runs the sides add up to what was
    read. Rows without a time are never late. Each batch writes the newest time so far, one
    row, which the next one reads.
    """
    spark = events.sparkSession
    side = F.when(F.col("ts") < F.col("bound"), "late").when(F.col("reason").isNotNull(), "rejected").otherwise("accepted")
    none = spark.createDataFrame([(None,)], events.select("ts").schema)

    def write(rows: DataFrame, batch_id: int) -> None:
        before = spark.read.schema(none.schema).parquet(f"{folder}/newest/batch={batch_id - 1}") if batch_id else none
        bound = before.select((F.col("ts") - F.expr(f"INTERVAL {late}")).alias("bound"))
        told = rows.crossJoin(F.broadcast(bound)).withColumn("reason", _reason())  # one row
        told.withColumn("side", side).drop("bound").write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        rows.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/read/batch={batch_id}")
        rows.select("ts").unionByName(before).agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{folder}/newest/batch={batch_id}")

    _finish(events, folder, "append", write)
    schema = T.StructType([*events.schema.fields, T.StructField("reason", T.StringType()), T.StructField("side", T.StringType())])
    return _written(spark, schema, f"{folder}/out"), _written(spark, T.StructType.fromDDL("n LONG"), f"{folder}/read")


def dedupe(events: DataFrame, folder: str, late: str = LATE) -> DataFrame:
    """Each event id once: the copy that came first.

    The ids stay in the state store for as long as a copy can still come in time; copies
    further apart than ``late`` count as events of their own, and rows that are late fall away
    (``late_accounting`` tells which).
    """
    return _changes(events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]), folder)


def last_writer(events: DataFrame, folder: str, keys: list[str], removed: Column) -> DataFrame:
    """The last event of each key by (ts, event_id), whatever the order of arrival; keys whose last event removes them are left out.

    The state is one event a key; a batch puts out the keys that it changes.
    """
    last = F.max_by(F.struct(*events.columns), F.struct("ts", "event_id")).alias("x")
    changes = _changes(events.groupBy(*keys).agg(last).select("x.*"), folder, "update")
    return changes.groupBy(*keys).agg(last).select("x.*").where(~removed)


def daily_rates(events: DataFrame, folder: str, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Number, value and share of undos of events by window and type; no event is too late.

    The state is a row for each window and type; a batch puts out those that it changes. With
    ``slide`` the windows overlap.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rates = events.groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    changes = _changes(rates.select(F.col("window.start").alias("day"), "event_type", "n", "value"), folder, "update")
    return changes.groupBy("day", "event_type").agg(F.max("n").alias("n"), F.max_by("value", "n").alias("value"))  # n grows with each change


def undo_rates(rates: DataFrame, undo: str = "error") -> DataFrame:
    """day, events, undos and their share, from ``daily_rates``."""
    undos = F.sum(F.when(F.col("event_type") == undo, F.col("n")).otherwise(0))
    return rates.groupBy("day").agg(F.sum("n").alias("events"), undos.alias("undos"), F.try_divide(undos, F.sum("n")).alias("undo_rate"))


def sessions(events: DataFrame, folder: str, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Review sessions of each user: events no further apart than ``gap``. Events later than ``late`` behind the newest are left out.

    Open sessions are part of the result, so each batch writes all sessions anew.
    """
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    s = s.select("user_id", F.col("session_window.start").alias("start"), "n")
    _finish(s, folder, "complete", lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{folder}/out/v={batch_id}"))
    spark = events.sparkSession
    if not _there(spark, f"{folder}/out"):
        return spark.createDataFrame([], s.schema)
    out = spark.read.schema(T.StructType([*s.schema.fields, T.StructField("v", T.LongType())])).parquet(f"{folder}/out")
    newest = out.agg(F.max("v")).first()[0]
    return out.where(F.col("v") == newest).drop("v")


def undo_matches(events: DataFrame, is_undo: Column, folder: str, within: str = "1 hour", late: str = LATE) -> DataFrame:
    """Undo events with the decisions of their user that they follow within the bound, whatever the order of arrival.

    A join of two streams: each side waits in the state store until nothing within the bound
    and ``late`` can come any more.
    """
    kept = events.withColumn("undo", F.coalesce(is_undo, F.lit(False))).withWatermark("ts", late)
    d = kept.where("NOT undo").select(F.col("event_id").alias("decision_id"), F.col("user_id").alias("d_user"), F.col("ts").alias("d_ts"))
    u = kept.where("undo").select(F.col("event_id").alias("undo_id"), "user_id", "ts")
    on = (F.col("user_id") == F.col("d_user")) & (F.col("ts") > F.col("d_ts")) & (F.col("ts") <= F.col("d_ts") + F.expr(f"INTERVAL {within}"))
    return _changes(u.join(d, on).select("decision_id", "undo_id", "user_id"), folder)


FIRST = 10  # operations of a user that count as early


def _early_late(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ops, undos, first = state.get if state.exists else (0, 0, "[]")
    rows = pd.concat(list(frames))
    undone = rows["event_type"] == "error"
    ops, undos = ops + len(rows), undos + int(undone.sum())
    new = zip(rows["ts"].astype("int64"), rows["event_id"].astype("int64"), undone.astype("int64"))
    earliest = sorted([*map(tuple, json.loads(first)), *((int(t), int(i), int(u)) for t, i, u in new)])[:FIRST]
    state.update((ops, undos, json.dumps(earliest)))
    early = sum(u for _, _, u in earliest)
    yield pd.DataFrame({"user_id": [key[0]], "ops": [ops], "early_undos": [early], "late_undos": [undos - early]})


def early_late(events: DataFrame, folder: str) -> DataFrame:
    """Undos among each user's first ten operations by time and later ones, whatever the order of arrival.

    The state of a user is two counts and the ten earliest operations so far.
    """
    schema = "user_id LONG, ops LONG, early_undos LONG, late_undos LONG"
    counts = events.groupBy("user_id").applyInPandasWithState(_early_late, schema, "ops LONG, undos LONG, first STRING", "update", GroupStateTimeout.NoTimeout)
    out = _changes(counts, folder, "update")
    return out.groupBy("user_id").agg(F.max_by(F.struct("ops", "early_undos", "late_undos"), "ops").alias("x")).select("user_id", "x.*")


def document_qc(docs: DataFrame, lexicon: DataFrame, folder: str) -> DataFrame:
    """The batch metrics for each document as it comes (stream-static join with the lexicon)."""
    spark = docs.sparkSession
    schema = qc.document_qc(spark.createDataFrame([], docs.schema), lexicon).schema
    _finish(docs, folder, "append", lambda rows, batch_id: qc.document_qc(rows, lexicon).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}"))
    return _written(spark, schema, f"{folder}/out")
