"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows_are_those_of_the_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = sorted((plain(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()), key=repr)
    rel = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted((plain(tuple(r[names.index(c)] for c in sorted(names))) for r in rel.fetchall()), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
