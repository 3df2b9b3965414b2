"""Every registered reference query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from textflow.queries import ORACLES, QUERIES
from textflow.queries.base import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = duck.sql(ORACLES[name])
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_fuzzy_names_of_common_and_lonely_names(spark, tmp_path):
    """Names that many rows bear, names two edits from all others, short and empty ones; against the SQL."""
    names = ["abcdefgh"] * 5 + ["abcdefgX", "aXcdefXh", "qrstuvw", "qrstXvX", "qrstYvY", "abc", "abX", "aXY", "", "x", "yz", None, "lonely name", "nm 0001", "nm 0002", "nm 0013", "nm 0123"]
    names += [f"row {i:04}" for i in range(60)] * 2
    rows = [(i, n) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["sim_fuzzy_names"](spark, str(tmp_path)).select("a", "b", "dist", "place").collect())
    assert got == sorted(c.sql(ORACLES["sim_fuzzy_names"]).fetchall())


def test_fuzzy_names_broadcasts_only_what_was_counted(spark, tmp_path):
    """Lonely names: what is left of them after two deletions is far more than the names' file and goes through no broadcast."""
    spark.range(4000).selectExpr("id AS s_suppkey", "substring(sha2(string(id), 256), 1, 12) AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    plan = QUERIES["sim_fuzzy_names"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join [key" in line]
    assert joins and all("SortMergeJoin" in line for line in joins) and "BroadcastHashJoin" not in plan
