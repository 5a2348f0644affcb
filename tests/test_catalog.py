"""Each query against its SQL counterpart on the smallest tables."""

import math

import duckdb
import pytest

from larkstead.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(catalog.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert mine == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert [r["worker"] for r in entry.entry(spark).orderBy("worker").collect()] == ["w1", "w2", "w3"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["jobs_get"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,37)" in plan
    plan = catalog.QUERIES["jobs_claim_next"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
