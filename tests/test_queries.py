"""Every query with SQL gives DuckDB's rows; every other runs and keeps its schema."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from corpusmill import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "asDict") or isinstance(value, list | tuple):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    return value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(_plain(v) for v in r)) for r in found.select(columns).collect())
    wanted = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    at = [wanted.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(_plain(r[i]) for i in at)) for r in wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    found = catalog.QUERIES[name](spark, SF)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
