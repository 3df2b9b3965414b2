"""Streams over tables of many files, out of time order, stopped and resumed."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textflow.queries import QUERIES
from textflow.streaming import ledger as S

SF = "/root/testdata/sf0.001"
STREAMS = sorted(n for n in QUERIES if n.startswith("stream_"))


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The smallest tables as folders of part files, dealt by a hash so that no file is in time order."""
    top = tmp_path_factory.mktemp("many")
    for name in ("events", "documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(6, F.rand(3)).write.parquet(f"file://{top}/{name}.parquet")
    return f"file://{top}"


@pytest.mark.parametrize("name", STREAMS)
def test_folder_tables_give_the_same(spark, folders, name):
    rows = lambda d: sorted(map(str, QUERIES[name](spark, d).collect()))
    got = rows(folders)
    assert got and got == rows(SF)


def events(rng, ids):
    start = datetime(2024, 1, 1)
    return [(i, start + timedelta(minutes=rng.randint(0, 60 * 24 * 40)), i % 7, rng.choice(["click", "error", "view"]), 1.0, '{"k": 1}') for i in ids]


def test_stopped_and_resumed(spark, tmp_path):
    """A second run meets copies of events that the first has seen, matches across both, and older events; a third has no new file."""
    rng = random.Random(5)
    first, second = events(rng, range(120)), events(rng, range(120, 200))
    second += first[:30]
    table = f"file://{tmp_path}/events.parquet"
    for k, rows in enumerate((first, second, [])):
        if rows:
            spark.createDataFrame(rows, S.EVENTS).repartition(5).write.mode("append").parquet(table)
        stream = lambda: S.event_stream(spark, f"file://{tmp_path}", files=2)
        at = lambda name: f"file://{tmp_path}/{name}"
        so_far = first if k == 0 else first + second
        once = S.dedupe(stream(), at("dedupe"))
        assert sorted(r.event_id for r in once.collect()) == sorted({r[0] for r in so_far})
        pairs = S.undo_matches(stream(), F.col("event_type") == "error", at("undo"), within="12 hours")
        want = Counter((d[0], u[0]) for d in so_far for u in so_far if u[3] == "error" != d[3] and u[2] == d[2] and timedelta(0) < u[1] - d[1] <= timedelta(hours=12))
        assert Counter((r.decision_id, r.undo_id) for r in pairs.collect()) == want
        last = S.last_writer(stream(), at("lww"), ["user_id"], F.col("event_type") == "error")
        newest = {u: max((r for r in so_far if r[2] == u), key=lambda r: (r[1], r[0])) for u in {r[2] for r in so_far}}
        assert {r.user_id: r.event_id for r in last.collect()} == {u: r[0] for u, r in newest.items() if r[3] != "error"}
        early = {r.user_id: (r.ops, r.early_undos, r.late_undos) for r in S.early_late(stream(), at("early")).collect()}
        for u in newest:
            own = [r[3] == "error" for r in sorted((r for r in so_far if r[2] == u), key=lambda r: (r[1], r[0]))]
            assert early[u] == (len(own), sum(own[:10]), sum(own[10:]))
        rates = {(r.day, r.event_type): r.n for r in S.daily_rates(stream(), at("rates")).collect()}
        assert rates == Counter((r[1].replace(hour=0, minute=0), r[3]) for r in so_far)
        opened = S.sessions(stream(), at("sessions"), gap="6 hours")
        assert sum(r.n for r in opened.collect()) == len(so_far)


def test_resumed_document_qc(spark, tmp_path):
    """Documents of both runs have their metrics; a run without new files gives them again."""
    lexicon = spark.createDataFrame([("mill", False)], "word string, pending boolean")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    stream = lambda: S.event_stream(spark, f"file://{tmp_path}", "documents.parquet", schema)
    for k in (1, 2, 2):
        if k == 1 or not spark.read.parquet(f"file://{tmp_path}/documents.parquet").where("doc_id = 2").count():
            spark.createDataFrame([(k, "A mill stood here.", "en", "s", 0)], schema).write.mode("append").parquet(f"file://{tmp_path}/documents.parquet")
        got = S.document_qc(stream(), lexicon, f"file://{tmp_path}/qc")
        assert sorted(r.doc_id for r in got.collect()) == list(range(1, k + 1)) and len(got.columns) == 10


def test_late_rows_are_kept_apart(spark, tmp_path):
    """Accepted, late and rejected add up to what was read, over two runs; only rows behind earlier batches are late."""
    start = datetime(2024, 1, 1)
    row = lambda i, hour, value=1.0: (i, start + timedelta(hours=hour), 1, "click", value, '{"k": 1}')
    runs = ([row(1, 100), row(2, 0), row(3, 50, None)], [row(4, 98), row(5, 60), row(6, 10, None), row(7, 300)], [row(8, 250), row(9, 299), (10, None, 1, "click", 1.0, '{"k": 1}')])
    want = {1: "accepted", 2: "accepted", 3: "rejected", 4: "accepted", 5: "late", 6: "late", 7: "accepted", 8: "late", 9: "accepted", 10: "accepted"}
    seen = 0
    for rows in runs:
        spark.createDataFrame(rows, S.EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events.parquet")
        told, read = S.late_accounting(S.event_stream(spark, f"file://{tmp_path}"), f"file://{tmp_path}/late", late="24 hours")
        seen += len(rows)
        assert {r.event_id: r.side for r in told.collect()} == {i: want[i] for i in range(1, seen + 1)}
        assert read.agg(F.sum("n")).first()[0] == seen == told.count()
