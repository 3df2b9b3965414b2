"""Acceptance and rewrite checks on a small chapter of our own."""

import pytest

from textflow.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tiers"))
    easy, hard = "The cat sat on the mat.", "The cat zorbed and flimmed on the mat."
    docs = [
        # accepted: rates fall from A to B
        (0, "It is not here and it is never there, said Anna."),
        (1, "The cat zorbed and flimmed and quonked on the mat."), (2, "The cat zorbed and sat on the cat and the mat."), (3, easy),
        # a number of its own, both negations and the name gone; M is missing
        (4, "It was not 3 and it was never 4, said Anna."), (5, hard), (7, "The cat sat on 9."),
        # B is harder than A
        (9, easy), (10, easy), (11, hard),
        (12, None), (13, ""),
    ]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "the cat sat on the mat and was")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    talk = [(1, 0, "the cat xylophones sat"), (1, 1, "the cat blork sat"), (1, 2, "the xylophones blork grond")]
    spark.createDataFrame(talk, "conv_id long, turn long, text string").write.parquet(f"{at}/conversations.parquet")
    return at


def test_report(spark, folder):
    rows = {(r.chapter, r.tier): r for r in QUERIES["acc_tier_report"](spark, folder).collect()}
    assert len(rows) == 8  # empty texts have no segments
    assert (rows[0, "A"].unnoted, rows[0, "M"].unnoted, rows[0, "B"].unnoted) == (3, 1, 0)
    assert rows[0, "A"].rate_pct == pytest.approx(30.0) and rows[0, "B"].tokens == 6
    low = rows[1, "B"]
    assert (low.invented, low.lost, low.turned) == (1, 1, 1)
    assert (rows[2, "A"].invented, rows[2, "A"].notes, rows[2, "A"].worst_at) == (0, 0, None)


def test_verdicts(spark, folder):
    rows = {r.chapter: r for r in QUERIES["acc_cross_tier_summary"](spark, folder).collect()}
    assert {c: (r.missing, r.verdict) for c, r in rows.items()} == {0: ("", "accepted"), 1: ("M", "missing"), 2: ("", "check")}
    inversions = {r.chapter: r.inversions for r in QUERIES["acc_chapter_verdict"](spark, folder).collect()}
    assert inversions == {0: 0, 1: 0, 2: 1}


def test_rewrite(spark, folder):
    rows = {r.turn: tuple(r)[2:] for r in QUERIES["gate_rewrite"](spark, folder).collect()}
    assert rows == {0: (1, 2, 0), 1: (1, 2, 1)}  # blork is new at first; then grond beside blork, and xylophones is explained already


def test_texts_are_read_few_times(spark, folder):
    """Counts of a segment come from one reading, its unnoted words and notes from one each; the report's suspects take two more."""
    for name, most in (("acc_cross_tier_summary", 3), ("acc_chapter_verdict", 3), ("acc_tier_report", 5)):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Relation [doc_id" in line for line in plan.splitlines()) <= most
