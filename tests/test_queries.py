"""Queries against their oracle SQL on the smallest tables, and what every query must keep."""

import math

import duckdb
import numpy as np
import pytest

from cohortloom import queries as reference

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = reference.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, np.floating)):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return int(value) if isinstance(value, np.integer) else value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, duck, name):
    df = reference.queries()[name](spark, SF)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    rows = lambda columns, data: sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in data), key=repr)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(reference.queries()) <= set(entry.queries())
