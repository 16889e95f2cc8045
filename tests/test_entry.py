"""Driver contract and a DuckDB comparison of a few queries at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_mod
from covary.plans import oracle_sql as plan_sql
from covary.plans import queries as plan_queries
from tests.conftest import SF001


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["p_brand", "dimension", "category", "n", "k", "slope", "t_stat",
                          "p_value", "corr", "rank"]
    assert df.count() >= 0


def test_every_sql_key_is_a_query():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    assert set(plan_queries()) == set(plan_sql())


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ["orders", "lineitem", "part", "customer", "supplier", "nation", "events"]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plan_sql()))
def test_query_matches_sql_twin(spark, duck, name):
    con = duck
    df = entry_mod.queries()[name](spark, SF001)
    rel = con.sql(entry_mod.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    a = sorted((tuple(_norm(r[c]) for c in order) for r in df.collect()), key=repr)
    idx = [rel.columns.index(c) for c in order]
    b = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert a == b
