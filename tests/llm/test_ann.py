import numpy as np
from pyspark.sql import functions as F

from textflow.llm import ann


def brute(rows, k=5):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 50 == 0:
            near = sorted(((-ann._exact(v, w[None])[0], i) for i, w in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_recall_ties_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(600)]
    same = rows[50][1]
    rows += [(700 + i, same) for i in range(300)]  # a third of the rows share one vector
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] + [1.0] * 7), (2150, [None] + [1.0] * 7), (2200, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 5 * len(want)
    assert [i for i, _ in got[50]] == [700, 701, 702, 703, 704] and [i for i, _ in got[700]] == [50, 701, 702, 703, 704]


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert ann.search(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_near_copies_scaled_and_mostly_copied_rows(spark):
    """Rows on which code distances alone tell little: tight bundles, one vector for most rows, scaled copies, huge and tiny values."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 8))
    rows = [(i, centres[i % 4] + 1e-4 * rng.normal(size=8)) for i in range(2000)]
    rows += [(3000 + i, np.ones(8)) for i in range(3000)]  # most rows share one vector
    rows += [(7000 + i, (1 + i) * centres[0]) for i in range(120)] + [(8000 + i, 10.0 ** rng.integers(-18, 18) * rng.normal(size=8)) for i in range(400)]
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for q in ids[ids % 50 == 0]:
        score, others = ann._exact(m[ids == q][0], m[ids != q]), ids[ids != q]
        best = np.lexsort((others, -score))[:5]
        assert got[q] == [(others[i], score[i]) for i in best]


def test_squares_that_overflow(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 2e-200]), (2, [1e200, -1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]
