"""Every registered query with SQL gives the same rows as DuckDB on the same files."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
ORACLE = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, sf, name):
    ours = entry_point.queries()[name](spark, sf)
    columns = sorted(ours.columns)
    theirs = duck.execute(ORACLE[name])
    names = [d[0] for d in theirs.description]
    assert columns == sorted(names)
    left = sorted(tuple(comparable(r[c]) for c in columns) for r in ours.collect())
    places = [names.index(c) for c in columns]
    right = sorted(tuple(comparable(r[i]) for i in places) for r in theirs.fetchall())
    assert left == right
