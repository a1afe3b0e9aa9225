"""Every query that has SQL gives the same rows as an engine that has no part in it."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(k for k in set(QUERIES) - set(SQL) if not (k[0] == "p" and k[1].isdigit())))
def test_without_sql_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() >= 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0
