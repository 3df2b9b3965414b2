"""Repairs of annotations and plot anchors, on texts of our own and against plain code."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textflow.operators import anchors as P
from textflow.operators import annot as A
from textflow.operators import glosses as G

SEGS = "doc_id long, seg_idx int, body string"


def flat(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(G.flatten(F.col("t"))).first()[0]


def test_nested_glosses_become_one_layer(spark):
    for text, want in {
        "Mollie（莫丽（名字）） ran.": "Mollie（莫丽） ran.",
        "a barn（谷仓（see hay（草）））, b": "a barn（谷仓）, b",
        "deep（一（二（三（四））））": "deep（一）",
        "word（abc（d））": "word（abcd）",
        "no word:（外（内））": "no word:（外（内））",
        "open（一 and mill（磨（坊））": "open（一 and mill（磨（坊））",  # never closed: left alone
        "stray）mill（磨（坊））": "stray）mill（磨）",
        "plain（平）": "plain（平）",
        "": "",
    }.items():
        assert flat(spark, text) == want, text
        assert flat(spark, want) == want
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(G.flatten(F.col("t"))).first()[0] is None


def random_text(rng):
    out = []
    for _ in range(rng.randint(0, 12)):
        w = rng.choice(["mill", "Mill", "barn", "hay", "don't"])
        out.append(w + rng.choice(["", "", "（磨）", "（坊）", "（磨（坊））", "（", "）"]) + rng.choice([" ", ", ", ". "]))
    return "".join(out)


def test_tokens_put_together_give_the_text(spark):
    rng = random.Random(3)
    rows = [(i, 1, random_text(rng) + rng.choice(["é x", "5%", "a"])) for i in range(60)]
    segs = spark.createDataFrame(rows, SEGS)
    assert sorted(map(tuple, G.rebuilt(G.tokens(segs)).collect())) == rows


@pytest.mark.parametrize("keep", ["all", "first"])
def test_repair_is_idempotent_and_keeps_the_words(spark, keep):
    rng = random.Random(4)
    rows = [(i // 3, i % 3, "x " + random_text(rng)) for i in range(90)]
    segs = spark.createDataFrame(rows, SEGS)
    once = G.repair(segs, keep).cache()
    twice = {(r.doc_id, r.seg_idx): r for r in G.repair(once.select("doc_id", "seg_idx", "body"), keep).collect()}
    strip = lambda t: re.sub("（[^（）]*）", "", re.sub("（[^（）]*）", "", t))
    before = {(d, s): b for d, s, b in rows}
    glosses: dict = {}
    for r in once.orderBy("doc_id", "seg_idx").collect():
        again = twice[r.doc_id, r.seg_idx]
        assert again.body == r.body and again.changed == 0 and not again.nested
        assert strip(before[r.doc_id, r.seg_idx]) == strip(r.body) or "（" in strip(before[r.doc_id, r.seg_idx]) or "）" in strip(before[r.doc_id, r.seg_idx])
        for w, g in re.findall(A.PATTERN, r.body):
            glosses.setdefault((r.doc_id, w.lower()), []).append(g)
    assert all(len(set(g)) == 1 for g in glosses.values())
    assert keep == "all" or all(len(g) == 1 for g in glosses.values())


def test_first_gloss_wins_across_segments(spark):
    segs = spark.createDataFrame([(1, 1, "mill（磨） and mill（坊）"), (1, 2, "Mill（厂） barn（仓）"), (2, 1, "mill（厂）")], SEGS)
    rows = {(r.doc_id, r.seg_idx): (r.body, r.changed) for r in G.repair(segs).collect()}
    assert rows == {(1, 1): ("mill（磨） and mill（磨）", 1), (1, 2): ("Mill（磨） barn（仓）", 1), (2, 1): ("mill（厂）", 0)}
    rows = {(r.doc_id, r.seg_idx): r.body for r in G.repair(segs, "first").collect()}
    assert rows == {(1, 1): "mill（磨） and mill", (1, 2): "Mill barn（仓）", (2, 1): "mill（厂）"}


@pytest.mark.parametrize(
    ("body", "action", "word", "gloss", "want", "status"),
    [
        ("The Windmills turn. A windmill.", "insert", "windmill", "风车", "The Windmills（风车） turn. A windmill.", "ok"),
        ("The Windmills（风车） turn. A windmill.", "insert", "windmill", "风车", None, "no-op"),
        ("Nothing here.", "insert", "windmill", "风车", None, "not-found"),
        ("mill（一） mill（二） mills（三）", "dedupe", "mill", None, "mill（一） mill mills", "ok"),
        ("mill（一） mill", "dedupe", "mill", None, None, "no-op"),
        ("mill（一） mill（二）", "strip", "mill", None, "mill mill", "ok"),
        ("mill（一） mill（二）", "sense", "mill", "三", "mill（三） mill（二）", "ok"),
        ("mill（三）", "sense", "mill", "三", None, "no-op"),
        ("barn", "sense", "mill", "三", None, "not-found"),
        ("mill（一（二））", "flatten", None, None, "mill（一）", "ok"),
        ("a new word, a new word", "revert", "new", "old", "a old word, a new word", "ok"),
        ("a word (x+", "revert", "(x+", "[y]", "a word [y]", "ok"),
        ("a word", "revert", "new", "old", None, "not-found"),
    ],
)
def test_actions(spark, body, action, word, gloss, want, status):
    segs = spark.createDataFrame([(1, 1, body), (1, 2, body)], SEGS)
    asked = spark.createDataFrame([(1, 1, action, word, gloss)], "doc_id long, seg_idx int, action string, word string, gloss string")
    assert [tuple(r) for r in G.apply_actions(segs, asked).collect()] == [(1, 1, want or body, status)]


def test_actions_keep_a_segment_in_one_row(spark):
    """Forms that are shorter or longer than the word, marked words, and no rows of tokens on the way."""
    bodies = ["Stories（一） story's STORY storm（二）", "stop, stopped（一） stopping（二）", "a（一） b", "don't-（一） dont 'tis", "'", ""]
    segs = spark.createDataFrame([(1, i, b) for i, b in enumerate(bodies)], SEGS)
    asked = spark.createDataFrame([(1, 0, "strip", "story", None), (1, 1, "dedupe", "stopped", None), (1, 2, "sense", "a", "三"), (1, 3, "insert", "don't", "x"), (1, 4, "strip", "'", "x"), (1, 5, "strip", "a", "x")], "doc_id long, seg_idx int, action string, word string, gloss string")
    out = G.apply_actions(segs, asked)
    assert "generate" not in out._jdf.queryExecution().optimizedPlan().toString().lower().replace("generated", "")
    assert sorted((r.seg_idx, r.body, r.status) for r in out.collect()) == [
        (0, "Stories story's STORY storm（二）", "ok"), (1, "stop, stopped（一） stopping（二）", "no-op"), (2, "a（三） b", "ok"), (3, bodies[3], "no-op"), (4, "'", "not-found"),
    ]


def test_issues(spark):
    segs = spark.createDataFrame([(1, 1, "mill（一"), (1, 2, "mill（一） barn（仓（x））"), (1, 3, "Mill（二）"), (2, 1, "fine（好）")], SEGS)
    assert sorted(map(tuple, G.issues(segs).collect())) == [(1, 1, "unclosed", "1/0"), (1, 2, "nested", "mill（一） barn（仓）"), (1, 2, "sense-conflict", "mill: 一 / 二")]
    docs = spark.createDataFrame([(1, "[P01] a [P02] b [P04] c [P04] d"), (2, "none"), (3, "[P1]"), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.kind, r.marker or "") for r in G.marker_issues(docs).collect()) == [(1, "duplicate", "P04"), (1, "gap", "P04"), (1, "gap", "P04"), (2, "missing", "")]


def test_anchors(spark):
    text = 'They sang "Four legs good" at Manor Farm. 《Beasts of England》 rose; the song of the song. Old Manor Farm / the end, of it'
    docs = spark.createDataFrame([(1, text), (2, None), (3, "one")], "doc_id long, text string")
    got = sorted(r.anchor for r in P.maximal(P.phrases(docs)).collect())
    assert "beasts of england" in got and "four legs good" in got and "old manor farm" in got
    assert not {"manor farm", "legs good", "song of the", "of it", "the end"} & set(got)


def test_maximal_anchors_like_a_plain_search(spark):
    rng = random.Random(5)
    rows = {(rng.randint(1, 4), " ".join(rng.choices(["ab", "cab", "b", "abc", "ca"], k=rng.randint(2, 5)))) for _ in range(150)}
    want = sorted((d, a) for d, a in rows if not any(d == e and a != b and a in b for e, b in rows))
    assert sorted(map(tuple, P.maximal(spark.createDataFrame(sorted(rows), "doc_id int, anchor string")).collect())) == want


def test_explicit_anchors(spark):
    text = "x\n锚点：Windmill、gun, 五\n - 锚点: a b|Gun\nno 锚点: z"
    assert spark.createDataFrame([(text,)], "t string").select(P.explicit(F.col("t"))).first()[0] == ["windmill", "gun", "a b"]
