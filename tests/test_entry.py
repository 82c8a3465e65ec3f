"""The registry, and every query that has SQL against that SQL on the smallest test tables."""

import datetime
import decimal
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
CORE = {n: f for n, f in __spark_entry__.queries().items() if not f.__module__.startswith("codeloom.llm")}
SQL = {n: s for n, s in __spark_entry__.oracle_sql().items() if n in CORE}


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def test_registry():
    assert set(SQL) <= set(CORE)
    assert {"p1_found", "p2_found", "p5_found"} <= set(CORE)


@needs_data
def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = CORE[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(x) for x in r) for r in df.select(*cols).collect())
    rel = duck.execute(SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    where = [names.index(c) for c in cols]
    assert got == Counter(tuple(plain(r[k]) for k in where) for r in rel.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    CORE[name](spark, DATA).write.format("noop").mode("overwrite").save()
