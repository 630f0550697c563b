"""The driver's contract on the SQL queries, against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from larkspur import queries as sql_queries

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(sql_queries.oracle_sql()) == set(sql_queries.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["o_orderkey"]


@pytest.mark.parametrize("name", sorted(sql_queries.queries()))
def test_query(spark, name):
    db = duckdb.connect()
    for table in ("region", "nation", "customer", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = sql_queries.queries()[name](spark, SF)
    expected = db.execute(sql_queries.oracle_sql()[name])
    columns = [x[0] for x in expected.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(expected.fetchall(), key=repr)
