"""The queries with SQL against DuckDB, over whole tables."""

import os

import duckdb
import pytest

from llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.duckdb_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    rel = con.sql(queries.duckdb_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(tuple, df.select(*rel.columns).collect()), key=repr) == sorted(rel.fetchall(), key=repr)
