"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from corvale.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return pd.Timestamp(value).isoformat() if hasattr(value, "isoformat") else value


def sorted_rows(columns, rows, order):
    return sorted((tuple(plain(row[columns.index(c)]) for c in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, database, name):
    found = registry.queries()[name](spark, DIR)
    rows = found.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    result = database.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    order = sorted(columns)
    assert sorted_rows(found.columns, [tuple(r) for r in rows], order) == sorted_rows(columns, result.fetchall(), order)


def test_entry_gives_rows(spark):
    assert registry.flagship(spark, DIR).count() > 0
