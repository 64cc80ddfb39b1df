"""Every registered query on the smallest tables, against its check SQL."""

import os

import pytest

import __spark_entry__ as driver

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def con():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'"
        )
    return connection


def ordered(rows, columns):
    by_name = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in by_name) for r in rows)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, con, name):
    frame = driver.queries()[name](spark, SF_DIR)
    rows = frame.collect()
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert ordered(rows, frame.columns) == ordered(cursor.fetchall(), columns)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
