"""Every registered query of the matrix against its DuckDB statement at sf0.01, and those that split
the 15 traces of sf0.001, whose parts need repair, there too."""

import math
from pathlib import Path

import duckdb
import pytest

from pyspark.sql import functions as F

from matrixloom.operators import split
from matrixloom.plans import queries as matrix

SF = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the test tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return str([plain(x) for x in v])
    try:
        return f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(v)


def rows(frame):
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def connect(folder):
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(matrix.ORACLE_SQL))
def test_agrees_with_duckdb(spark, duck, name):
    got, want = matrix.QUERIES[name](spark, str(SF)).toPandas(), duck.execute(matrix.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["hash_split_by_trace", "assignment_digest"])
def test_repaired_splits_agree(spark, name):
    small = SF.parent / "sf0.001"
    got, want = matrix.QUERIES[name](spark, str(small)).toPandas(), connect(small).execute(matrix.ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 9])
def test_repaired_splits_of_few_traces(spark, n):
    """The statement's moves against the operator's, for tables so small that parts are empty."""
    con = duckdb.connect()
    con.execute(f"create table events as select i as event_id, make_timestamp(i * 1000000) as ts, i % {n} + 100 * {n} as user_id, 'a' as event_type from range({3 * n}) t(i)")
    obs = spark.createDataFrame([(str(i % n + 100 * n),) for i in range(3 * n)], "trace_id string")
    got = split.assign_parts(obs.select(F.col("trace_id").alias("unit")).distinct(), 42, True).toPandas()
    want = con.execute(matrix.ORACLE_SQL["hash_split_by_trace"]).df()
    assert rows(got.rename(columns={"unit": "trace_id"})) == rows(want)


def test_entry(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark).collect()
    rows = {}
    for r in got:
        rows.setdefault((r.scope, r.task), []).append(r)
    tasks = {r.task for r in matrix.observations(spark, "/root/testdata/sf0.001").select("task").distinct().collect()}
    assert set(rows) == {("global", None)} | {("task", t) for t in tasks}
    for group in rows.values():
        want = min(group, key=lambda r: (-r.quality, r.cost_usd, r.latency_ms, r.model)).model
        assert {r.model for r in group} == {"m0", "m1", "m2"} and [r.model for r in group if r.is_best] == [want]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
