"""Streaming operators run over the tables' files; each must equal its batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexicon as L
from ..plans.layout import scratch
from ..streaming import ledger as S
from .base import ORACLES, query, table


def _events(spark, d):
    return S.event_stream(spark, d)


@query("stream_ingest_rejects", "SELECT CASE WHEN json_extract_string(props, '$.k') IS NULL OR value IS NULL THEN 'rejected' ELSE 'accepted' END AS side, count(*) AS n FROM events GROUP BY 1")
def stream_ingest_rejects(spark, d):
    ok, bad = S.ingest(_events(spark, d), scratch(spark, "ingest"))
    return ok.select(F.lit("accepted").alias("side")).unionByName(bad.select(F.lit("rejected").alias("side"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("stream_dedupe", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedupe(spark, d):
    return S.dedupe(_events(spark, d), scratch(spark, "dedupe")).select("event_id", "user_id", "event_type")


@query("stream_last_writer", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def stream_last_writer(spark, d):
    return S.last_writer(_events(spark, d), scratch(spark, "lww"), ["user_id"], F.col("event_type") == "error").select("user_id", "event_id", "event_type")


@query("stream_daily_rates", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def stream_daily_rates(spark, d):
    return S.daily_rates(_events(spark, d), scratch(spark, "daily")).withColumn("value", F.round("value", 4))


@query("stream_sessions", "WITH g AS (SELECT *, ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, no")
def stream_sessions(spark, d):
    return S.sessions(_events(spark, d), scratch(spark, "sessions"))


@query("stream_undo_matches", "SELECT d.event_id AS decision_id, u.event_id AS undo_id, u.user_id FROM events d JOIN events u ON u.user_id = d.user_id AND u.ts > d.ts AND u.ts <= d.ts + INTERVAL 1 HOUR WHERE d.event_type <> 'error' AND u.event_type = 'error'")
def stream_undo_matches(spark, d):
    return S.undo_matches(_events(spark, d), F.col("event_type") == "error", scratch(spark, "undo"))


@query("stream_early_late", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) SELECT user_id, count(*) AS ops, count(*) FILTER (rn <= 10 AND event_type = 'error') AS early_undos, count(*) FILTER (rn > 10 AND event_type = 'error') AS late_undos FROM r GROUP BY user_id")
def stream_early_late(spark, d):
    return S.early_late(_events(spark, d), scratch(spark, "early"))


@query("stream_undo_rates", "SELECT date_trunc('day', ts) AS day, count(*) AS events, count(*) FILTER (event_type = 'error') AS undos, count(*) FILTER (event_type = 'error') / count(*) AS undo_rate FROM events GROUP BY 1")
def stream_undo_rates(spark, d):
    return S.undo_rates(S.daily_rates(_events(spark, d), scratch(spark, "rates")))


@query("stream_sliding_rates", """SELECT s AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 12 HOUR, date_trunc('day', ts) + INTERVAL 12 HOUR]) AS s FROM events)
WHERE s <= ts AND ts < s + INTERVAL 1 DAY GROUP BY ALL""")
def stream_sliding_rates(spark, d):
    return S.daily_rates(_events(spark, d), scratch(spark, "sliding"), slide="12 hours").withColumn("value", F.round("value", 4))


@query("stream_late_counts", "SELECT side, count(*) FILTER (kind = side OR side = 'read') AS n FROM (SELECT CASE WHEN json_extract_string(props, '$.k') IS NULL OR value IS NULL THEN 'rejected' ELSE 'accepted' END AS kind FROM events), (SELECT unnest(['accepted', 'late', 'rejected', 'read']) AS side) GROUP BY side")
def stream_late_counts(spark, d):
    """Rows accepted, rejected, late and read. Files come in no order of time, so the bound is wide here."""
    rows, read = S.late_accounting(_events(spark, d), scratch(spark, "late"))
    sides = [rows.agg(F.count_if(F.col("side") == side).alias("n")).select(F.lit(side).alias("side"), "n") for side in ("accepted", "late", "rejected")]
    total = read.agg(F.sum("n").alias("n")).select(F.lit("read").alias("side"), "n")
    return sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(total)


@query("stream_document_qc")
def stream_document_qc(spark, d):
    docs = S.event_stream(spark, d, "documents.parquet", "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    return S.document_qc(docs, L.lexicon_of(table(spark, d, "benchmark")), scratch(spark, "qc"))


def use_batch_oracles() -> None:
    ORACLES["stream_document_qc"] = ORACLES["qc_document"]
