"""Every query with a SQL twin equals it on the small tables, in names and values."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tallyframe.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(x):
    if isinstance(x, float) and x != x:
        return None
    return tuple(plain(y) for y in x) if isinstance(x, (list, tuple, np.ndarray)) else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in catalog.queries() if n.startswith("r_")))
def test_rows_only_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
