import random

import numpy as np
import pytest

from textflow.llm import mixing as M


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    vocab = {"en": "the of and to is lamp river stone".split(), "de": "der die und zu ist lampe fluss stein".split()}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(30)), lang, 1.0) for i in range(300) for lang in ["en" if i % 4 else "de"]]
    rows += [(900, None, None, 1.0), (901, "", "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rate double")
    return docs, docs.where("doc_id < 150 OR doc_id >= 900").selectExpr("doc_id", "lang AS domain")


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_targets_are_met(tables, least):
    docs, labelled = tables
    out, fitted = M.plan(docs, labelled, targets={"en": 0.5, "de": 0.5}, least=least)
    assert all(abs(g / w - 1) < 0.01 for g, w in zip(fitted["got"], fitted["want"]))
    rows = out.collect()
    assert len(rows) == 302 and all(r.rate >= least and r.n_copies >= least for r in rows)
    tokens = {lang: sum(r.n_tokens * r.n_copies for r in rows if r.lang == lang) for lang in ("en", "de")}
    assert 0.8 < tokens["de"] / tokens["en"] < 1.25
    if not least:
        assert sum(fitted["want"]) == pytest.approx(sum(fitted["start"]))


def nnls(a, b):
    """Nonnegative least squares by active sets (Lawson and Hanson)."""
    free, x = np.zeros(a.shape[1], dtype=bool), np.zeros(a.shape[1])
    for _ in range(500):
        w = a.T @ (b - a @ x)
        if free.all() or w[~free].max() < 1e-9:
            return x
        free[np.flatnonzero(~free)[w[~free].argmax()]] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if z[free].min() > 0:
                x = z
                break
            bad = free & (z <= 0)
            step = (x[bad] / (x[bad] - z[bad])).min()
            x = x + step * (z - x)
            free &= x > 1e-12
    raise AssertionError


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_same_fit_as_active_sets(spark, least):
    """Overlapping posteriors and targets out of reach: the same residual as another way to solve it; no step raises it."""
    rng = np.random.default_rng(7)
    p = rng.dirichlet([0.6, 0.6, 0.6], 12)
    steps = np.round(p * M.STEPS).astype(int)
    tokens = rng.integers(5, 400, 12).astype(float)
    cells = spark.createDataFrame([(s.tolist(), float(t)) for s, t in zip(steps, tokens)], "steps array<int>, tokens double").coalesce(1)
    fitted = M.solve(cells, ["a", "b", "c"], {"a": 0.96, "b": 0.03, "c": 0.01}, least)
    p = steps / steps.sum(axis=1, keepdims=True)
    start, want = np.array(fitted["start"]), np.array(fitted["want"])
    risk = lambda got: float((((np.array(got) - want) ** 2) / start).sum() / 2)
    a = (p * tokens[:, None]).T / np.sqrt(start)[:, None]
    x = nnls(a, want / np.sqrt(start) - a @ np.full(12, least)) + least
    assert risk(fitted["got"]) == pytest.approx(risk((p * tokens[:, None]).T @ x), rel=5e-2, abs=1e-4 * sum(tokens))  # plain gradient steps, at most ROUNDS of them
    r, last = np.ones(12), np.inf
    for e in fitted["history"]:
        r = np.maximum(least, r - p @ np.array(e))
        now = risk((p * tokens[:, None]).T @ r)
        assert now <= last + 1e-9
        last = now


def test_no_labels_no_documents(tables):
    docs, labelled = tables
    out, _ = M.plan(docs, labelled.where("false"))
    assert {r.n_copies for r in out.collect()} == {1}
    assert M.plan(docs.where("false"), labelled)[0].collect() == []


def test_rare_domain_meets_its_target(spark):
    """One token in 2,000 has to grow almost tenfold, and with equal targets two thousandfold."""
    cells = spark.createDataFrame([([M.STEPS, 0], 2000.0), ([0, M.STEPS], 1.0)], "steps array<int>, tokens double").coalesce(1)
    for targets, grown in ((None, 2000**0.3), ({"a": 0.5, "b": 0.5}, 2000)):
        fitted = M.solve(cells, ["a", "b"], targets, least=1.0)
        assert abs(fitted["got"][1] / grown - 1) < 1e-3 and abs(fitted["got"][0] / 2000 - 1) < 1e-3
        assert fitted["residual"] < 1e-3


def test_small_posteriors_are_kept(spark):
    k = 120
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = {"domains": [str(i) for i in range(k)], "prior": [-float(i == 0) * 9 for i in range(k)], "weights": {}}
    steps = M.with_posterior(docs, model).first().steps
    assert min(steps) > 0 and abs(sum(steps) / M.STEPS - 1) < 1e-3
