"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
TABLES = [p.stem for p in sorted(Path(FOLDER).glob("*.parquet"))]

pytestmark = pytest.mark.skipif(not TABLES, reason="test tables are not mounted")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def _cell(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "null"
    return repr(float(value)) if isinstance(value, float) else str(value)


def _rows(frame):
    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(map(_cell, row)) for row in ordered.itertuples(index=False))


@pytest.mark.parametrize("name", list(driver.oracle_sql()))
def test_query_equals_its_sql(spark, sql, name):
    found = driver.queries()[name](spark, FOLDER).toPandas()
    expected = sql.execute(driver.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert _rows(found) == _rows(expected)


@pytest.mark.parametrize("name", [n for n in driver.queries() if n not in driver.oracle_sql()])
def test_query_without_sql_has_rows(spark, name):
    assert driver.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() == 7
