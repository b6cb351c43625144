"""Every registered query on the smallest tables, against its SQL check where it has one."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

import __spark_entry__ as driver  # noqa: E402
from check import TABLES, normal  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES.split():
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_every_check_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", list(driver.queries()))
def test_query(spark, db, name):
    df = driver.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = db.sql(sql)
    assert sorted(rel.columns) == columns
    assert normal(got) == normal(rel.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
