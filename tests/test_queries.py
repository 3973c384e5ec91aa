"""Every registered query against its SQL in DuckDB, whole tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from veilmark.plans import oracle, queries

SF = "/root/testdata/sf0.001"
QUERIES = queries.queries()
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{name}'")
    return connection


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(repr(row) for row in result.fetchall())
    got = sorted(repr(tuple(row)) for row in frame.select(*columns).collect())
    assert got == want and got


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == ["doc_id", "text", "detect_error", "mappings", "status"]
    assert frame.where("status = 'redacted'").count() > 0
