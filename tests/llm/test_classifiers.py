"""Quality (NBSVM) and toxicity (nnPU): held-out accuracy, edge rows, degenerate labels."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textflow.llm import quality, toxicity

from .conftest import words


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        w = words(rng, 40).split()
        if bad:
            w = [x + "***" if k % 2 else x for k, x in enumerate(w)]
        if toxic:
            w[rng.randrange(40)] = "grumvil" + rng.choice("aeiou") + rng.choice("bdfg")
            w[rng.randrange(40)] = "skorpat"
        rows.append((i, " ".join(w), 0.0))
        labels.append((i, int(not bad), int(toxic), "x"))
    rows += [(2000, None, None), (2001, "", 1.0), (2002, "z " * 60_000, 1.0)]
    labels += [(None, 1, 1, "x"), (5, None, None, "x"), (3000, 1, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize(("module", "label", "column", "mod", "held"), [(quality, "quality", "quality_score", 4, 2), (toxicity, "toxic", "tox_score", 3, 1)])
def test_held_out_accuracy(labelled, module, label, column, mod, held):
    docs, labels = labelled
    model = module.fit(docs, labels)
    rows = {r.doc_id: r[column] for r in module.score(docs, model).collect()}
    assert len(rows) == 903 and all(0 <= s <= 1 for s in rows.values())
    truth = {r.doc_id: r[label] for r in labels.where(f"{label} IS NOT NULL AND doc_id < 900").collect()}
    out = [k for k in truth if zlib.crc32(str(k).encode()) % mod == held]
    assert np.mean([(rows[k] >= 0.7) == bool(truth[k]) for k in out]) > 0.95
    assert rows[2000] == rows[2001]


@pytest.mark.parametrize(("module", "label", "column", "mod", "held"), [(quality, "quality", "quality_score", 4, 2), (toxicity, "toxic", "tox_score", 3, 1)])
@pytest.mark.parametrize("few", [False, True])
def test_labels_of_the_held_out_fold_have_no_part(labelled, module, label, column, mod, held, few):
    """Flipping them, or leaving them out, changes no score: on many rows and on few."""
    docs, labels = labelled
    docs = docs.where("doc_id < 150") if few else docs
    out = F.crc32(F.col("doc_id").cast("string")) % mod == held
    flipped = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
    scores = [sorted((r.doc_id, r[column]) for r in module.score(docs, module.fit(docs, x)).collect()) for x in (labels, flipped, labels.where(~out))]
    assert scores[0] == scores[1] == scores[2] and len({s for _, s in scores[0]}) > 1


@pytest.mark.parametrize(("query", "mod", "held"), [("op4_quality_nbsvm", 4, 2), ("op9_toxicity_nnpu", 3, 1)])
def test_registered_query(spark, query, mod, held):
    """held_out is the fold and predicted the threshold, for every row; rows of null and repeated ids are scored too."""
    rows = (quality.QUERIES | toxicity.QUERIES)[query](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1


@pytest.mark.parametrize(("module", "column"), [(quality, "quality_score"), (toxicity, "tox_score")])
def test_null_and_repeated_ids(labelled, module, column):
    docs, labels = labelled
    odd = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    rows = module.score(odd, module.fit(odd, labels.unionByName(labels.where("doc_id < 40")))).collect()
    assert len(rows) == 946 and sum(r.doc_id is None for r in rows) == 3
    by_text: dict = {}
    assert all(by_text.setdefault(r.text, r[column]) == r[column] for r in rows)


@pytest.mark.parametrize(("module", "label", "column"), [(quality, "quality", "quality_score"), (toxicity, "toxic", "tox_score")])
def test_without_labels_or_documents(spark, labelled, nothing, module, label, column):
    docs, labels = labelled
    none = module.fit(docs, labels.where("false"))
    assert module.score(docs, none).count() == 903
    assert module.score(nothing, none).collect() == []
    one_class = module.fit(docs, labels.where("doc_id < 20").selectExpr("doc_id", f"1 AS {label}"))
    assert all(0 <= r[0] <= 1 for r in module.score(docs, one_class).select(column).collect())


def test_nnpu_keeps_the_risk_of_clean_text_nonnegative():
    rng = np.random.default_rng(1)
    label = (rng.random(400) < 0.2).astype(int)
    rows = [np.array([0] if y or rng.random() < 0.05 else [1]) for y in label]
    w, b = toxicity.nnpu_fit(rows, label, 2, 0.2)
    assert w[0] + b > 0 > w[1] + b


def test_nnpu_learns_from_documents_without_a_label(labelled, monkeypatch):
    """Only some positives are labelled: all other documents are the unlabelled set, and its risk goes below zero."""
    docs, labels = labelled
    seen, gradient = [], toxicity.risk_gradient
    monkeypatch.setattr(toxicity, "risk_gradient", lambda *a: seen.append(gradient(*a)) or seen[-1])
    model = toxicity.fit(docs, labels.where("toxic = 1 AND doc_id % 2 = 0"))
    rows = {r.doc_id: r.tox_score for r in toxicity.score(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.where("toxic IS NOT NULL AND doc_id < 900").collect()}
    out = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(rows[k] >= 0.7) == bool(truth[k]) for k in out]) > 0.95
    assert abs(model["prior"] - np.mean(list(truth.values()))) < 0.05
    assert min(risk for _, risk in seen) < 0


def test_nnpu_steps_back_where_the_risk_of_clean_text_is_negative():
    """Positives whose word the unlabelled rows lack: without the step back the weight grows for ever."""
    rows = [np.array([0])] * 50 + [np.array([1])] * 200
    label, drawn = np.repeat([1, 0], [50, 200]), np.repeat([False, True], [50, 200])
    f = np.repeat([4.0, -4.0], [50, 200])
    g, risk = toxicity.risk_gradient(f, label == 1, drawn, 0.3)
    assert risk < 0 and (g[:50] > 0).all() and (g[50:] < 0).all()
    w, b = toxicity.nnpu_fit(rows, label, 2, 0.3, rounds=2000, drawn=drawn)
    assert w[0] + b > w[1] + b and abs(w[0] + b) < 10


def test_dual_coordinate_descent_separates():
    rows = [np.array([0]), np.array([1]), np.array([0, 2]), np.array([1, 2])] * 5
    y = np.array([1.0, -1, 1, -1] * 5)
    w = quality.hinge_dual_cd(rows, y, np.ones(3), c=10.0, epochs=50)
    assert all((w[r].sum() + w[-1]) * t > 0 for r, t in zip(rows, y))


def test_shapes():
    assert [quality.shape(t) for t in ("Hello,", "ABC", "x***", "a||||", "12-34")] == ["Aa,", "A", "a***", "a|||", "0-0"]
