"""Clusters against plain distances, ties, odd vectors, large components."""

import hashlib
import math

import numpy as np
import pytest

from textflow.llm import orchard as O


def brute(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None))[:k]
    centroids = [v for _, _, v in start]

    def near():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = near()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((i if i is not None else -1, c, d) for (i, _), (d, c) in zip(kept, near())), centroids


def vectors(seed, dim, n=300):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rng.integers(-3, 4, dim) / 256)]) for i in range(n)]  # few values: many ties
    rows += [(900 + i, rows[7][1]) for i in range(150)]  # a third of the rows share one vector
    rows += [rows[5], (5, rows[6][1]), (None, rows[9][1])]
    return rows + [(2000, None), (2001, [1.0] * (dim - 1)), (2002, [None] + [1.0] * (dim - 1)), (2003, [float("nan")] + [1.0] * (dim - 1)), (2004, [float("inf")] * dim), (2005, [])]


@pytest.mark.parametrize("large", [False, True])
def test_same_as_plain_search(spark, large):
    rows = vectors(2, 6)
    if large:
        rows += [(3000, [9e6, -9e6, 1.0, 0.0, 0.0, 0.0]), (3001, [9e6, -9e6, 2.0, 0.0, 0.0, 0.0])]  # beyond SAFE: Python's integers
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string").repartition(5)
    found, centroids = O.cluster(df, k=12, rounds=4, dim=6)
    want, ends = brute(rows, 12, 4, 6)
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in found.collect()) == want
    assert [[int(x) for x in c] for c in centroids] == ends


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [5.0, 5.0])], "vec_id long, embedding array<float>")
    assert sorted(r.distance for r in O.cluster(df, dim=2)[0].collect()) == sorted(d for _, _, d in brute([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [5.0, 5.0])], 40, 5, 2)[0])
    assert O.cluster(df.where("false"), dim=2)[0].collect() == []
    assert [r.cluster for r in O.cluster(df.where("vec_id IS NULL"), dim=2)[0].collect()] == [0]


def test_the_walk_leaves_centroids_out():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-10_000, 10_000, (40, 2))
    x = centroids[rng.integers(0, 40, 2_000)] + rng.integers(-40, 40, (2_000, 2))
    at, best, worked = O.assign(x, centroids, *O.neighbours(centroids))
    d = np.stack([O.squared(x, c) for c in centroids], axis=1)
    assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and worked < 0.5 * d.size


def test_registered_query(spark):
    got = O.QUERIES["op12_orchard"](spark, "/root/testdata/sf0.001")
    rows = got.collect()
    assert len(rows) == 500 and {r.inertia for r in rows} == {sum(r.distance for r in rows)}
    one = rows[0]
    assert one.cluster_inertia == sum(r.distance for r in rows if r.cluster == one.cluster) and len(one.centroid_sha256) == 64
