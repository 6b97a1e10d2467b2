"""Every registered query runs, and those with SQL agree with DuckDB over the same tables."""

import math

import duckdb
import pytest

from tablewright import catalog, session

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}")
    return str(v)


@pytest.fixture(scope="module")
def db(sf_dir):
    out = duckdb.connect()
    for t in session.TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in ORACLE:
        cursor = db.execute(ORACLE[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    else:
        assert got


def test_scans_are_pruned_and_filtered(spark, sf_dir):
    plan = QUERIES["filter_eq_literal"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "o_custkey" not in plan.split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in QUERIES["top_k"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
