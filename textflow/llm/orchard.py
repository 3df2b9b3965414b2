"""Centroid clustering with Orchard's search.

Every centroid keeps a list of the others by rising distance. A vector that stands at a
centroid walks that centroid's list; as soon as it finds a closer one it jumps to that one's
list. Centroids once compared are marked, and the walk ends strictly beyond twice the vector's
present distance: by the triangle inequality nothing further on can be as near, ties included.
A block of vectors walks side by side, so each step is a few numpy calls.

All numbers are integers, so results don't depend on how rows are dealt out. Only the
centroids, k rows, go through the driver; partial sums are put together by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K = 40
ROUNDS = 5
DIM = 64
SCALE = 256
SAFE = 1 << 27  # components within this keep 64 * (2 * SAFE) ** 2 below 2 ** 63
BLOCK_ROWS = 2_048


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=-1)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by rising squared distance (ties: smaller number), and these distances."""
    d = np.stack([squared(centroids, c) for c in centroids])
    order = np.argsort(d, axis=1, kind="stable")
    lists = np.stack([row[row != i] for i, row in enumerate(order)]) if len(d) > 1 else np.empty((1, 0), np.int64)
    return lists, np.take_along_axis(d, lists, axis=1) if len(d) > 1 else np.empty((1, 0), d.dtype)


def assign(x: np.ndarray, centroids: np.ndarray, lists: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: smaller number), its squared distance, and how many distances were worked out."""
    n, k = len(x), len(centroids)
    at = np.zeros(n, dtype=np.int64)
    best = squared(x, centroids[0])
    met = np.zeros((n, k), dtype=bool)
    met[:, 0] = True
    place = np.zeros(n, dtype=np.int64)
    live = np.arange(n)
    worked = n
    while len(live):
        live = live[place[live] < k - 1]
        live = live[far[at[live], place[live]] <= 4 * best[live]]
        if not len(live):
            break
        to = lists[at[live], place[live]]
        place[live] += 1
        fresh = ~met[live, to]
        rows, to = live[fresh], to[fresh]
        met[rows, to] = True
        d = squared(x[rows], centroids[to])
        worked += len(rows)
        closer = (d < best[rows]) | ((d == best[rows]) & (to < at[rows]))
        rows, to = rows[closer], to[closer]
        at[rows], best[rows], place[rows] = to, d[closer], 0
    return at, best, worked


def _integers(rows: pd.Series, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components as 64-bit integers where no square can overflow, else as Python's integers of any size."""
    x = np.floor(SCALE * np.array(rows.tolist(), dtype=np.float64))
    if np.abs(x).max(initial=0) <= SAFE and max((abs(int(c)) for c in centroids.ravel()), default=0) <= SAFE:
        return x.astype(np.int64), centroids.astype(np.int64)
    return np.vectorize(int, otypes=[object])(x), centroids.astype(object)


def _assigned(batches: Iterator[pd.DataFrame], centroids: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    lists = far = None
    kind = None
    for pdf in batches:
        for start in range(0, len(pdf), BLOCK_ROWS):
            part = pdf.iloc[start : start + BLOCK_ROWS]
            x, c = _integers(part["v"], centroids)
            if kind != c.dtype:
                lists, far = neighbours(c)
                kind = c.dtype
            at, best, _ = assign(x, c, lists, far)
            yield part, x, at, best


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, dim = centroids.shape
        total = np.zeros((k, dim), dtype=object)
        n = np.zeros(k, dtype=np.int64)
        for _, x, at, _ in _assigned(batches, centroids):
            for c in np.unique(at):
                total[c] += x[at == c].sum(axis=0).astype(object)
            n += np.bincount(at, minlength=k)
        hit = np.flatnonzero(n)
        if len(hit):  # a task without vectors has no sums
            yield pd.DataFrame({"cluster": hit.astype(np.int32), "n": n[hit], "sums": [[str(v) for v in total[c]] for c in hit]})

    return run


def _labels(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, _, at, best in _assigned(batches, centroids):
            yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": at.astype(np.int32), "distance": np.array([int(d) for d in best], dtype=np.int64)})

    return run


def kept(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id and v (doubles): vectors of exactly ``dim`` components, none null or non-finite."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("v") == dim) & finite)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance of each kept vector, as a written table; and the final centroids.

    The first centroids are the ``k`` vectors (all, if fewer) with the smallest hash of
    ``2:<vec_id>``; rows with a null id are clustered but never start a centroid, and rows of
    one id are ordered by their components. Repeated rows count each. An empty table gives no
    rows. A squared distance beyond 64 bits fails with an overflow.
    """
    spark = vectors.sparkSession
    rows = common.materialize(kept(vectors, dim), "vectors")
    first = rows.where("vec_id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256), "vec_id", "v").limit(k).collect()
    if not first:
        first = rows.orderBy("v").limit(1).collect()  # only rows without an id: one cluster
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.empty((0, dim), object)
    centroids = np.array([[int(c) for c in np.floor(SCALE * np.array(r["v"], dtype=np.float64))] for r in first], dtype=object)
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    for _ in range(rounds):
        found = rows.mapInPandas(_sums(centroids), "cluster int, n long, sums array<string>").groupBy("cluster").agg(F.sum("n").alias("n"), *total)
        for r in found.collect():  # k rows at most
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dim)]
    return common.materialize(rows.mapInPandas(_labels(centroids), "vec_id long, cluster int, distance long"), "clusters"), centroids


def op12_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance, inertia and centroid of every vector of ``embeddings`` that has 64 finite components (see ``cluster`` for odd rows)."""
    found, centroids = cluster(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows at most
    whole = sum(int(r["d"]) for r in sums)
    rows = [(r["cluster"], int(r["d"]), whole, hashlib.sha256(",".join(str(int(c)) for c in centroids[r["cluster"]]).encode()).hexdigest()) for r in sums]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Every round as SQL: all distances, the smallest by distance and number, exact floored means."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id, v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL QUALIFY c < {K})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT row_id, vec_id, x, c, d FROM (
    SELECT v.row_id, v.vec_id, v.v AS x, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i} c)
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, c) = 1)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(n.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range({DIM})) AS i FROM a{i}) GROUP BY c, i) GROUP BY c) n ON n.c = c{i}.c)"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(f.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} f ON f.c = a.c"""
    )


QUERIES = {"op12_orchard": op12_orchard}
ORACLES = {"op12_orchard": _oracle()}
