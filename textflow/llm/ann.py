"""Nearest neighbours: an inverted file with product-quantised residuals and an exact check behind it.

Coarse centroids and residual codebooks are fitted on a bounded sample of distinct vectors; every
vector is indexed. A query first visits its nearest lists, where asymmetric distances over the codes
pick the entries that get an exact cosine; so it has found k others within some distance. Then it
visits every list that may reach into that distance (by the list's radius) and leaves out entries
whose code distance less their coding error is beyond it. So nothing nearer can be missed, however
the vectors lie; on nearly isotropic ones few lists are left out. Lists are packed into cells of
bounded size, and queries are dealt into parts, so that no list or query set is ever one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FIT_SAMPLE = 20_000  # vectors that centroids and codebooks are fitted on, at most
K = 5
SUBSPACES, CODES = 16, 64
CELL_ROWS = 32_768  # entries of a cell, at most
QUERY_ROWS = 16_384  # distinct queries of a part, about
STEP = 1 << 21  # entries of a matrix of distances
SLACK = 1e-6  # by which distances of unit vectors may be off


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: id known; vector not null, not zero, all components finite; of the most common length."""
    ok = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return ok.where((F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(vectors: DataFrame, n: int) -> dict:
    """Centroids and codebooks from at most ``FIT_SAMPLE`` distinct vectors, scaled to unit length; a vector that many rows share counts once."""
    take = vectors.orderBy("key", F.col("ids")[0]).limit(FIT_SAMPLE).select("v").toPandas()
    x = np.array(take["v"].tolist(), dtype=np.float64)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = max(1, min(4096, math.isqrt(max(1, n))))
    coarse = kmeans(x, lists)
    rest = x - coarse[np.argmin((coarse**2).sum(1) - 2 * x @ coarse.T, axis=1)]
    books = [kmeans(part, CODES, seed=11 + i) for i, part in enumerate(np.array_split(rest, min(SUBSPACES, x.shape[1]), axis=1))]
    return {"coarse": coarse, "books": books, "dim": x.shape[1]}


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-300)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` to all of ``y``."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))


def _encode(rest: np.ndarray, model: dict) -> np.ndarray:
    parts = np.array_split(rest, len(model["books"]), axis=1)
    return np.stack([np.argmin((b**2).sum(1) - 2 * p @ b.T, axis=1) for p, b in zip(parts, model["books"])], axis=1).astype(np.uint8)


def _decode(codes: np.ndarray, model: dict) -> np.ndarray:
    return np.concatenate([b[codes[:, i]] for i, b in enumerate(model["books"])], axis=1)


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), dtype=np.float64)


def _index_rows(batches: Iterator[pd.DataFrame], model: dict) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            x = _unit(_matrix(pdf["v"]))
            near = np.argmin(_far(x, model["coarse"]), axis=1)
            rest = x - model["coarse"][near]
            yield pd.DataFrame({"ids": pdf["ids"], "v": pdf["v"], "list": near, "codes": [c.tobytes() for c in _encode(rest, model)], "far": np.sqrt((rest**2).sum(1))})


def _query_rows(batches: Iterator[pd.DataFrame], model: dict, probes: int) -> Iterator[pd.DataFrame]:
    """A row for each cell that a query visits: the cells of its ``probes`` nearest lists, or of all lists that reach within ``limit``."""
    for pdf in batches:
        for at in range(0, len(pdf), 1024):
            part = pdf.iloc[at : at + 1024]
            far = _far(_unit(_matrix(part["v"])), model["coarse"])
            reach = np.partition(far, probes - 1, axis=1)[:, probes - 1] if probes else np.full(len(part), np.inf)
            limit = part["limit"].to_numpy()
            cells = np.zeros((len(part), model["cells"]), dtype=bool)
            row, hit = np.nonzero(_open(far, reach, limit, model["radius"]))
            cells[row, model["cell"][hit]] = True
            for i in np.nonzero(model["parts"] > 1)[0]:  # a list of several cells
                cells[:, model["cell"][i] : model["cell"][i] + model["parts"][i]] = cells[:, [model["cell"][i]]]
            row, cell = np.nonzero(cells)
            yield pd.DataFrame({"key": part["key"].to_numpy()[row], "v": part["v"].to_numpy()[row], "reach": reach[row], "limit": limit[row], "cell": cell, "part": part["part"].to_numpy()[row]})


def _open(far: np.ndarray, reach: np.ndarray, limit: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which lists a query visits."""
    return (radius >= 0) & (far <= reach[:, None] + SLACK) & (far - radius <= limit[:, None] + SLACK)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine in double precision, the sums taken in component order; vectors are scaled by powers of two, so that no square overflows."""
    q, v = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1]) for x in (q, v))
    dot = np.zeros(len(v))
    nq = nv = 0.0
    for j in range(v.shape[1]):
        dot = dot + q[..., j] * v[:, j]
        nq, nv = nq + q[..., j] * q[..., j], nv + v[:, j] * v[:, j]
    return dot / (np.sqrt(nq) * np.sqrt(nv))


def _search_cell(shared, k: int):
    def run(key, queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        model = shared.value
        out = [pd.DataFrame({"key": np.array([], dtype=np.int64), "ids": pd.Series([], dtype=object), "score": np.array([], dtype=float)})]
        if not len(queries) or not len(index):
            return out[0]
        v = _matrix(index["v"])
        x = _unit(v)
        codes = np.frombuffer(b"".join(index["codes"]), dtype=np.uint8).reshape(len(index), -1)
        lists, place = np.unique(index["list"].to_numpy(), return_inverse=True)
        coded = model["coarse"][lists][place] + _decode(codes, model)
        error = np.sqrt(((x - coded) ** 2).sum(1))
        ids = index["ids"].to_numpy()
        first = np.array([i[0] for i in ids], dtype=np.int64)
        qkey, qv, reach, limit = queries["key"].to_numpy(), _matrix(queries["v"]), queries["reach"].to_numpy(), queries["limit"].to_numpy()
        step = max(1, STEP // len(index))
        for at in range(0, len(queries), step):
            q = qv[at : at + step]
            u = _unit(q)
            seen = _open(_far(u, model["coarse"][lists]), reach[at : at + step], limit[at : at + step], model["radius"][lists])[:, place]
            far = _far(u, coded)
            far[~seen] = np.inf
            # k + 1 entries are surely within the (k + 1)-th smallest sum of code distance and coding error
            near = limit[at : at + step]
            if len(index) > k:
                near = np.minimum(near, np.partition(far + error, k, axis=1)[:, k])
            cos = u @ x.T
            cos[~(seen & (far - error <= near[:, None] + SLACK))] = -np.inf
            least = np.partition(cos, -(k + 1), axis=1)[:, -(k + 1)] if len(index) > k else np.full(len(q), -np.inf)
            row, col = np.nonzero((cos >= least[:, None] - 1e-12) & (cos > -np.inf))
            score = np.concatenate([np.zeros(0)] + [_exact(q[row[i : i + 65_536]], v[col[i : i + 65_536]]) for i in range(0, len(row), 65_536)])
            order = np.lexsort((first[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) <= k
            out.append(pd.DataFrame({"key": qkey[at + row[keep]], "ids": ids[col[keep]], "score": score[keep]}))
        return pd.concat(out[1:])

    return run


def _cells(coarse: np.ndarray, rows: np.ndarray, most: int) -> dict:
    """The lists packed into cells of about ``most`` entries, near lists together; a larger list has several cells."""
    cell, parts, at, free, order = np.zeros(len(rows), dtype=int), np.ones(len(rows), dtype=int), -1, 0, [0]
    left = np.ones(len(rows), dtype=bool)
    left[0] = False
    while left.any():
        d = ((coarse - coarse[order[-1]]) ** 2).sum(1)
        d[~left] = np.inf
        order.append(int(np.argmin(d)))
        left[order[-1]] = False
    for i in order:
        if rows[i] > most:
            parts[i] = -(-rows[i] // most)
            cell[i], at, free = at + 1, at + parts[i], 0
        else:
            if rows[i] > free:
                at, free = at + 1, most
            cell[i], free = max(at, 0), free - rows[i]
    return {"cell": cell, "parts": parts, "cells": int((cell + parts).max())}


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """The ``k`` nearest of each query row among all other rows: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding. Equal vectors are one entry of the index that holds
    its k + 1 smallest ids, and equal queries are searched for once; so a vector that a third
    of the rows share costs one entry. All k nearest are found: the visit of the nearest lists
    only sets how far the second one has to look.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == sizes["d"]).withColumn("q", is_query).withColumn("key", F.xxhash64("v", F.lit("vector")))
    # the k + 1 smallest ids of each distinct vector, in two steps: first within 64 salts, then over them
    salted = Window.partitionBy("key", "v", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = rows.select("key", "v", "vec_id").withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    distinct = few.groupBy("key", "v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    distinct = common.materialize(distinct, "ivf-distinct")
    entries = distinct.count()
    fitted = fit(distinct, entries)
    lists = len(fitted["coarse"])
    coded = spark.sparkContext.broadcast(fitted)
    index = distinct.select("ids", "v").mapInPandas(lambda it: _index_rows(it, coded.value), "ids array<long>, v array<double>, list int, codes binary, far double")
    index = common.materialize(index.withColumn("salt", F.xxhash64("ids")), "ivf")
    count, radius = np.zeros(lists, dtype=int), np.full(lists, -1.0)
    for r in index.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # a row for each of 4096 lists at most
        count[r["list"]], radius[r["list"]] = r["n"], r["far"]
    most = min(CELL_ROWS, max(2048, -(-entries // (2 * spark.sparkContext.defaultParallelism))))
    model = fitted | {"radius": radius} | _cells(fitted["coarse"], count, most)
    shared = spark.sparkContext.broadcast(model)
    cells = F.broadcast(spark.createDataFrame([(i, int(model["cell"][i]), int(model["parts"][i])) for i in range(lists)], "list int, cell int, parts int"))
    asked = rows.where("q").select("key", "v").distinct()
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
    dealt = index.join(cells, "list").withColumn("cell", (F.col("cell") + F.pmod("salt", F.col("parts"))).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("cell", "part", "list", "ids", "v", "codes")

    def found(queries: DataFrame, probes: int) -> DataFrame:
        """Ids within the k + 1 best entries of each query, of its nearest lists or (probes 0) of all lists within its limit."""
        visits = queries.select("key", "v", "limit", "part").mapInPandas(lambda it: _query_rows(it, shared.value, probes), "key long, v array<double>, reach double, limit double, cell int, part int")
        hits = visits.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInPandas(_search_cell(shared, k), "key long, ids array<long>, score double")
        best = Window.partitionBy("key").orderBy(F.desc("score"), F.col("ids")[0])
        return hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("key", "score", F.explode("ids").alias("vec_id"))

    far = found(asked.withColumn("limit", F.lit(float("inf"))), max(1, math.isqrt(lists)))
    last = F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(k + 1))  # the (k + 1)-th, so k others
    limits = far.groupBy("key").agg(F.when(last.isNotNull(), F.sqrt(F.greatest(2 - 2 * last, F.lit(0.0)))).alias("limit"))
    limits = asked.join(limits, "key", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    hits = found(common.materialize(limits, "ivf-limits"), 0)
    # at most (k + 1) * (k + 1) ids a key; each query row of the key drops its own
    queries = rows.where("q").select("key", F.col("vec_id").alias("query_id"))
    packed = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (
        queries.join(packed, "key")
        .select("query_id", F.posexplode(near).alias("pos", "x"))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
    )


def op10_ann_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every 50th row among all rows of ``embeddings``."""
    return search(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


QUERIES = {"op10_ann_ivfpq": op10_ann_ivfpq}
ORACLES: dict[str, str] = {}
