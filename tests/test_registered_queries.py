"""Every registered query against its SQL counterpart in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem".split()
QUERIES, ORACLE = registry._catalog_queries(), registry.oracle_queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def by_column_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([row[i] for i in order]) for row in rows)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    rows = result.fetchall()
    assert rows
    assert by_column_name(df.columns, df.collect()) == by_column_name(columns, rows)


def test_entry(spark):
    assert registry.entry(spark).columns == ["source_id", "target_id", "status", "n"]


def test_routines_are_made_by_many_tasks(spark):
    """A small file is one split; its rows are dealt before each becomes one per snapshot."""
    proc = registry.catalog_from(spark, SF_DIR).proc
    assert proc.rdd.getNumPartitions() > spark.read.parquet(f"{SF_DIR}/part.parquet").rdd.getNumPartitions()
