"""Every registered query against the plain SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as registered
from workload import crawling, extraction, merging, rows, similar

SF = "/root/testdata/sf0.001"
TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark
labels conversations""".split()
ORACLES = registered.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def in_order(rows):
    return sorted(rows, key=lambda row: tuple((v is None, "" if v is None else v) for v in row))


def test_every_query_has_an_oracle():
    own = {name for group in (rows, extraction, crawling, similar, merging) for name in group.QUERIES}
    assert own <= set(ORACLES) <= set(registered.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, engine, name):
    found = registered.queries()[name](spark, SF)
    columns = sorted(found.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = engine.execute(f"SELECT {quoted} FROM ({ORACLES[name]}) q").fetchall()
    assert sorted(engine.sql(ORACLES[name]).columns) == columns
    rows = [tuple(row) for row in found.select(*columns).collect()]
    assert len(rows) > 0
    assert in_order(rows) == in_order(expected)


def test_entry(spark):
    assert registered.entry(spark).count() > 0
