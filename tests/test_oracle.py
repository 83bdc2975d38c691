"""Every query with a SQL twin must return the same rows on the small tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as engine

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, str):
        return value
    return f"{float(value) + 0.0:.8g}" if value else "0"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def test_every_twin_belongs_to_a_query():
    assert set(engine.oracle_sql()) <= set(engine.queries())


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    got = engine.queries()[name](spark, SF_DIR)
    want = sql.execute(engine.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())


def test_entry(spark):
    assert engine.entry(spark).count() == 20
