"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic documents are the positives. The unlabelled set is a hash sample of all
documents outside the held-out fold, whether ``labels`` lists them or not; a label of 0 is
never read as clean. A linear model over word and word-prefix indicators minimises the risk
estimator

    pi * E_P[l(f)] + max(0, E_U[l(-f)] - pi * E_P[l(-f)])

(Kiryo et al., 2017). The class prior ``pi`` of the unlabelled set is given or estimated from
margins of rows that the model has not met, and scores are calibrated by the same estimator.
Prefix indicators let the model judge inflected forms it has not met.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import sigmoid

SAMPLE_ROWS = 16_000  # positive rows, and unlabelled rows, that a model is fitted on, at most
START_PRIOR = 0.1  # of the model whose margins the prior is estimated from
FEATURES = 8_192
PREFIXES = (4, 5, 6)
BITS = 22
THRESHOLD = 0.7
_EDGES = re.compile(r"^\W+|\W+$")


def word_features(word: str) -> list[str]:
    """A word's indicators: itself, and its prefixes. Marks around a word don't count."""
    w = _EDGES.sub("", word)
    if not w:
        return []
    return ["=" + w] + [f"{n}{w[:n]}" for n in PREFIXES if len(w) > n]


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _ids(text: str, cache: dict[str, list[int]]) -> set[int]:
    out: set[int] = set()
    for w in set(text.lower().split()):
        got = cache.get(w)
        if got is None:
            got = cache[w] = [_hash(f) for f in word_features(w)]
        out.update(got)
    return out


def _feature_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, 1 << BITS), dtype=np.int32)
    cache: dict[str, list[int]] = {}
    for pdf in batches:
        for text, label, drawn in zip(pdf["text"], pdf["label"], pdf["drawn"]):
            ids = np.fromiter(_ids(text or "", cache), dtype=np.int64)
            counts[0, ids] += label
            counts[1, ids] += drawn
        if len(cache) > 200_000:
            cache.clear()
    found = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(found), 50_000):
        i = found[at : at + 50_000]
        yield pd.DataFrame({"feature": i, "p": counts[0, i], "u": counts[1, i]})


def _selected(batches: Iterator[pd.DataFrame], keep: np.ndarray) -> Iterator[pd.DataFrame]:
    cache: dict[str, list[int]] = {}
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            ids = np.fromiter(_ids(text or "", cache), dtype=np.int64)
            at = np.searchsorted(keep, ids)
            at[at == len(keep)] = 0
            rows.append(np.unique(at[keep[at] == ids]).astype(np.int32) if len(keep) else np.empty(0, np.int32))
        if len(cache) > 200_000:
            cache.clear()
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "drawn": pdf["drawn"], "ids": rows})


def risk_gradient(f: np.ndarray, pos: np.ndarray, drawn: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Gradient of the non-negative risk by each row's margin, and the estimated risk of clean text."""
    n_p, n_u = pos.sum(), drawn.sum()
    s = sigmoid(f)  # derivative of the loss for class -1, log(1 + e^f); for class +1 it is s - 1
    softplus = np.logaddexp(0.0, f)
    neg_risk = float(softplus[drawn].mean() - prior * softplus[pos].mean())
    g = np.zeros(len(f))
    g[drawn] += s[drawn] / n_u
    g[pos] -= prior * s[pos] / n_p
    if neg_risk >= 0:
        g[pos] += prior * (s[pos] - 1) / n_p  # pi E_P[l(f)]
    else:  # the estimate of the clean part fell below zero: step back out of it
        g = -g
    return g, neg_risk


def nnpu_fit(rows: list[np.ndarray], label: np.ndarray, n_features: int, prior: float, rounds: int = 300, l2: float = 1e-3, drawn: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias. Rows with label 1 are the positives, those ``drawn`` (all, if not given) the unlabelled set."""
    pos = label == 1
    drawn = np.ones(len(rows), dtype=bool) if drawn is None else drawn
    if not pos.any() or not drawn.any():
        return np.zeros(n_features), -5.0
    lens = np.array([len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if lens.sum() else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), lens)
    n_u = drawn.sum()
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, rounds + 1):
        f = np.bincount(row, w[col], minlength=len(rows)) + b
        g, _ = risk_gradient(f, pos, drawn, prior)
        grad = np.append(np.bincount(col, g[row], minlength=n_features) + l2 * w / np.sqrt(n_u), g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def estimated_prior(margin_p: np.ndarray, margin_u: np.ndarray) -> float:
    """Share of positives in the unlabelled set: the least ratio of the two sets' parts above a margin.

    Each ratio bounds the share from above; the bound is met where clean text has no such
    margin (Blanchard et al., 2010). The ratio is taken where it is least with two standard
    errors added, so that margins that few positives reach don't decide.
    """
    cuts = np.sort(margin_p)[: max(1, len(margin_p) // 2)]
    p = 1 - np.searchsorted(np.sort(margin_p), cuts) / len(margin_p)
    u = (len(margin_u) - np.searchsorted(np.sort(margin_u), cuts) + 1) / (len(margin_u) + 1)
    sure = (u + 2 * np.sqrt(u * (1 - u) / len(margin_u))) / np.maximum(p - 2 * np.sqrt(p * (1 - p) / len(margin_p)), 1e-9)
    at = int(np.argmin(sure))
    return float(np.clip(u[at] / p[at], 1e-4, 0.9))


def calibration(margin_p: np.ndarray, margin_u: np.ndarray, prior: float, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset from margins to log odds, by Newton steps on E_U[log(1 + e^f)] - pi E_P[f], the logistic risk of P and U."""
    scale = float(np.std(margin_u)) or 1.0
    x = np.stack([margin_u / scale, np.ones(len(margin_u))])
    want = prior * np.array([margin_p.mean() / scale, 1.0])
    at = np.array([1.0, 0.0])
    ridge = np.array([1e-3, 0.0])  # keeps the slope finite where the two sets part entirely
    for _ in range(rounds):
        p = sigmoid(at @ x)
        g = (x * p).mean(axis=1) - want + ridge * at
        h = (x * np.maximum(p * (1 - p), 1e-9)) @ x.T / x.shape[1] + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, g)
        norm = float(np.abs(step).max())
        at = at - step * min(1.0, 2.0 / (norm + 1e-12))
        if norm < 1e-7:
            break
    return float(at[0] / scale), float(at[1])


def unlabelled_sample(docs: DataFrame, modulus: int, held: int, bound: int) -> DataFrame:
    """At most ``bound`` ids of documents outside the held-out fold, labelled or not, by a hash of the id."""
    share = bound / max(1, docs.count())
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % modulus != held))
    draw = F.xxhash64("doc_id", F.lit("unlabelled"))
    # a little more than the bound needs (a fold is left out), so that few rows are sorted
    ids = ids.where(F.pmod(draw, F.lit(1_000_003)) < 1_000_003 * min(1.0, 2 * share)).distinct()
    return ids.orderBy(draw, "doc_id").limit(bound)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, sample_rows: int = SAMPLE_ROWS, prior: float | None = None) -> dict:
    """Fit on at most ``sample_rows`` confirmed toxic and as many unlabelled documents outside the held-out fold.

    ``prior`` is the share of toxic documents among all; it is estimated if not given, from the
    same rows: neither the number nor the labels of rows in the held-out fold have a part in it.
    Rows with a null id or label are no examples; an id that is listed or stored several times
    counts once as an example. With no positive row at all every text scores near 0.
    """
    toxic = common.labelled_sample(labels.select("doc_id", "toxic").where("toxic = 1"), "toxic", modulus, held, sample_rows)
    drawn = unlabelled_sample(docs, modulus, held, sample_rows)
    both = toxic.select("doc_id", "label", F.lit(0).alias("drawn")).unionByName(drawn.select("doc_id", F.lit(0).alias("label"), F.lit(1).alias("drawn")))
    sample = common.materialize(both.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("drawn").alias("drawn")), "sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").repartition(8, "doc_id")
    counts = texts.mapInPandas(_feature_counts, "feature long, p int, u int").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    totals = sample.agg(F.coalesce(F.sum("drawn"), F.lit(0)).alias("u"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    n_u, n_p = max(1, totals["u"]), max(1, totals["p"])
    rate = (F.col("p") + F.col("u")) / F.lit(n_p + n_u)
    z = F.abs(F.col("p") / F.lit(n_p) - F.col("u") / F.lit(n_u)) / F.sqrt((rate + 1.0 / n_u) * F.lit(1.0 / n_p + 1.0 / n_u))
    best = counts.where("p + u >= 4").withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature")
    keep = np.sort(np.array([r[0] for r in best.collect()], dtype=np.int64))
    got = texts.mapInPandas(lambda it: _selected(it, keep), "doc_id long, label int, drawn int, ids array<int>").collect()
    got.sort(key=lambda r: r["doc_id"])
    rows = [np.array(r["ids"], dtype=np.int64) for r in got]
    pos, free = np.array([r["label"] == 1 for r in got], dtype=bool), np.array([r["drawn"] == 1 for r in got], dtype=bool)
    fold = np.array([r["doc_id"] % 5 for r in got])

    def margins(pi: float) -> np.ndarray:
        """Margins of rows that the fold's model has not met."""
        out = np.zeros(len(rows))
        for k in range(5):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            w, b = nnpu_fit([rows[i] for i in train], pos[train].astype(int), len(keep), pi, drawn=free[train])
            out[test] = [w[rows[i]].sum() + b for i in test]
        return out

    both = pos.any() and free.any()
    if prior is None:
        prior = START_PRIOR
        if both:
            margin = margins(prior)
            prior = estimated_prior(margin[pos], margin[free])
    w, b = nnpu_fit(rows, pos.astype(int), len(keep), prior, drawn=free)
    a, c = 1.0, 0.0
    if both:
        margin = margins(prior)
        a, c = calibration(margin[pos], margin[free], prior)
    return {"keep": keep, "w": w * a, "b": float(b * a + c), "prior": prior}


def _scorer(model: dict):
    weight = {int(k): float(x) for k, x in zip(model["keep"], model["w"])}
    bias = model["b"]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, tuple] = {}
        for texts in batches:
            out = []
            for text in texts:
                hit: set[int] = set()
                for w in set((text or "").lower().split()):
                    got = cache.get(w)
                    if got is None:
                        got = cache[w] = tuple(h for h in map(_hash, word_features(w)) if h in weight)
                    if got:
                        hit.update(got)
                out.append(bias + sum(weight[h] for h in sorted(hit)))
                if len(cache) > 300_000:
                    cache.clear()
            yield pd.Series(sigmoid(np.array(out, dtype=float)))

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with a column ``tox_score`` (0 to 1). Null texts are scored as empty ones."""
    return docs.withColumn("tox_score", F.pandas_udf(_scorer(model), "double")(F.col("text")))


def op9_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    A null text is scored as an empty one; a row with a null id is scored and not held out;
    repeated rows are scored alike; an empty table gives no row; texts are read whole.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        common.held_out(3, 1).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op9_toxicity_nnpu": op9_toxicity_nnpu}
ORACLES: dict[str, str] = {}
