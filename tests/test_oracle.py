"""Every registered query with SQL against DuckDB on the smallest tables, and the plans of a few."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(SF):
    pytest.skip("no tables", allow_module_level=True)

from meridion.plans.queries import ORACLE, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return f"{float(v):.9g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE[name])
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    mine = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    order = [list(rel.columns).index(c) for c in names]
    assert mine == sorted(tuple(norm(r[i]) for i in order) for r in rel.fetchall())


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    text = plan(QUERIES["S6_instance_scan"](spark, SF))
    assert "EqualTo(event_type,click)" in text and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in text
    assert "WindowGroupLimit" in plan(QUERIES["W1_last_n"](spark, SF))
    assert "CartesianProduct" not in plan(QUERIES["Z3_row_filter"](spark, SF)) and "NestedLoop" not in plan(QUERIES["Z3_row_filter"](spark, SF))
