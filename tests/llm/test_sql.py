"""The queries that SQL can express against DuckDB, whole tables and odd rows."""

import os

import duckdb
import pytest

from tests.llm.test_conversations import AWKWARD, COLUMNS
from veilmark.llm import queries

SF = "/root/testdata/sf0.01"
SQL = queries.oracle_sql()


def compared(spark, name, folder, duck):
    frame = queries.queries()[name](spark, folder)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(repr(row) for row in result.fetchall())
    assert sorted(repr(tuple(row)) for row in frame.select(*columns).collect()) == want
    return len(want)


@pytest.mark.parametrize("name", SQL)
def test_tables(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    assert compared(spark, name, SF, duck)


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_prefix_trie"])
def test_odd_conversations(spark, work, name):
    # turns of one number are ordered by digest in one and by text in the other
    rows = [r for r in AWKWARD if name.startswith("op11") or (r[0], r[1]) not in ((None, 0), (1, 1))]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], COLUMNS)
    frame.write.parquet(f"{work}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{work}/conversations.parquet/*.parquet'")
    assert compared(spark, name, work, duck)
