"""Quality classifier: naive Bayes support vectors (NBSVM, Wang & Manning 2012).

N-gram indicators are scaled by their class log-count ratio, and a linear model with hinge
loss is fitted to them by dual coordinate descent. The n-grams run over token shapes
(``Aa,`` ``a***`` ``|`` ``0-0``; a token that repeats its predecessor is marked) and over words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import sigmoid
from .toxicity import _hash

SAMPLE_ROWS = 12_000  # labelled rows that a model is fitted on, at most
FEATURES = 16_384
THRESHOLD = 0.7
_CLASSES = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "0"), (re.compile(r"(.)\1\1+"), r"\1\1\1"))


def shape(token: str) -> str:
    """Letters by case, digit runs as 0, long runs of one mark shortened to three."""
    def letters(m: re.Match) -> str:
        s = m.group()
        return "a" if s.islower() else "A" if s.isupper() else "Aa" if s[0].isupper() else "aA"

    s = _CLASSES[0][0].sub(letters, token)
    s = _CLASSES[1][0].sub("0", s)
    return _CLASSES[2][0].sub(r"\1\1\1", s)[:24]


class _Grams:
    """Distinct n-gram ids of texts; a bounded cache holds what was worked out for a token."""

    MASK = np.uint64((1 << 22) - 1)
    MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)

    def __init__(self) -> None:
        self.tokens: dict[str, tuple[int, int, int]] = {}

    def _token(self, t: str) -> tuple[int, int, int]:
        s = shape(t)
        got = self.tokens[t] = (_hash("s" + s) + 1, _hash("r" + s) + 1, _hash("w" + t))
        return got

    def of(self, text: str) -> np.ndarray:
        tokens = text.split()
        known = self.tokens
        ids = np.array([known.get(t) or self._token(t) for t in tokens], dtype=np.uint64).reshape(-1, 3)
        if len(known) > 400_000:
            known.clear()
        again = np.zeros(len(ids) + 2, dtype=bool)  # a token that repeats its predecessor has another shape id
        again[2:-1] = ids[1:, 2] == ids[:-1, 2] if len(ids) else False
        edge = np.zeros(len(ids) + 2, dtype=np.uint64)
        edge[1:-1] = ids[:, 0]
        edge[1:-1][again[1:-1]] = ids[:, 1][again[1:-1]]
        one = edge * self.MIX[0]
        two = one[:-1] * self.MIX[1] + edge[1:] * self.MIX[2]
        three = two[:-1] * self.MIX[1] + edge[2:] * self.MIX[0]
        size = np.array([_hash(f"n{len(tokens).bit_length()}")], dtype=np.uint64)
        grams = np.concatenate([one, two, three]) >> np.uint64(40)
        return np.unique(np.concatenate([grams & self.MASK, ids[:, 2], size])).astype(np.int64)


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    grams, counts = _Grams(), None
    for pdf in batches:
        if counts is None:
            counts = np.zeros((2, 1 << 22), dtype=np.int32)
        for text, label in zip(pdf["text"], pdf["label"]):
            counts[int(label == 1), grams.of(text or "")] += 1
    if counts is not None:
        found = np.flatnonzero(counts.sum(axis=0))
        for at in range(0, len(found), 50_000):
            i = found[at : at + 50_000]
            yield pd.DataFrame({"feature": i, "n0": counts[0, i], "n1": counts[1, i]})


def _selected(batches: Iterator[pd.DataFrame], keep: np.ndarray) -> Iterator[pd.DataFrame]:
    grams = _Grams()
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            ids = grams.of(text or "")
            at = np.searchsorted(keep, ids)
            at[at == len(keep)] = 0
            rows.append(np.unique(at[keep[at] == ids]).astype(np.int32) if len(keep) else np.empty(0, np.int32))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "ids": rows})


def hinge_dual_cd(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 0.1, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Linear SVM weights by dual coordinate descent (Hsieh et al., 2008); the last weight is the bias.

    Each class gets half of the total cost, so that the smaller one isn't drowned.
    """
    n = len(rows)
    w = np.zeros(len(scale) + 1)
    alpha = np.zeros(n)
    upper = np.where(y > 0, c * n / (2 * max(1, (y > 0).sum())), c * n / (2 * max(1, (y <= 0).sum())))
    values = [np.append(scale[r], 1.0) for r in rows]
    cols = [np.append(r, len(scale)) for r in rows]
    norms = [float(v @ v) for v in values]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            grad = y[i] * float(w[cols[i]] @ values[i]) - 1.0
            new = min(max(alpha[i] - grad / norms[i], 0.0), upper[i])
            if new != alpha[i]:
                w[cols[i]] += (new - alpha[i]) * y[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold.

    If only one class occurs the score is that class's share, whatever the text.
    """
    sample = F.broadcast(common.labelled_sample(labels.select("doc_id", "quality"), "quality", modulus, held, sample_rows))
    texts = docs.select("doc_id", "text").join(sample, "doc_id").repartition(8, "doc_id")
    counts = texts.mapInPandas(_gram_counts, "feature long, n0 int, n1 int").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("one")).first()
    n1, n0 = totals["one"], totals["n"] - totals["one"]
    if not n0 or not n1:
        share = (n1 + 0.5) / (n0 + n1 + 1)
        return {"keep": np.empty(0, np.int64), "w": np.empty(0), "b": float(np.log(share / (1 - share)))}
    ratio = F.log((F.col("n1") + 1.0) / (n1 + 2.0)) - F.log((F.col("n0") + 1.0) / (n0 + 2.0))
    weight = F.abs(ratio) * F.sqrt(F.col("n0") + F.col("n1"))
    best = counts.where("n0 + n1 >= 4").select("feature", ratio.alias("r"), weight.alias("z")).orderBy(F.desc("z"), "feature").limit(FEATURES)
    chosen = sorted((r["feature"], r["r"]) for r in best.collect())
    keep, r = np.array([k for k, _ in chosen], dtype=np.int64), np.array([x for _, x in chosen])
    got = texts.mapInPandas(lambda it: _selected(it, keep), "doc_id long, label int, ids array<int>").collect()
    got.sort(key=lambda x: x["doc_id"])
    rows = [np.array(x["ids"], dtype=np.int64) for x in got]
    y = np.array([1.0 if x["label"] == 1 else -1.0 for x in got])
    fold = np.array([x["doc_id"] % 3 for x in got])
    margin = np.zeros(len(rows))
    for k in range(3):  # margins for calibration come from models that have not met the row
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        w = hinge_dual_cd([rows[i] for i in train], y[train], r)
        margin[test] = [float(w[rows[i]] @ r[rows[i]]) + w[-1] for i in test]
    w = hinge_dual_cd(rows, y, r)
    a, c = common.platt(margin, y)
    return {"keep": keep, "w": w[:-1] * r * a, "b": float(w[-1] * a + c)}


def _scorer(model: dict):
    bias = model["b"]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams = _Grams()
        weight = np.zeros(1 << 22)
        weight[model["keep"]] = model["w"]
        for texts in batches:
            yield pd.Series(sigmoid(np.array([bias + weight[grams.of(t or "")].sum() for t in texts], dtype=float)))

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with a column ``quality_score`` (0 to 1). Null texts are scored as empty ones."""
    return docs.withColumn("quality_score", F.pandas_udf(_scorer(model), "double")(F.col("text")))


def op4_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        common.held_out(4, 2).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op4_quality_nbsvm": op4_quality_nbsvm}
ORACLES: dict[str, str] = {}
