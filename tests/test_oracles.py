import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, database, name):
    spark.catalog.clearCache()
    df = queries()[name](spark, FOLDER)
    result = database.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert rows(df.columns, df.collect()) == rows(result.columns, result.fetchall())


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
