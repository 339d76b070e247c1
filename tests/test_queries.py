"""Every registered query of the library against its SQL in DuckDB, at the smallest scale."""

import math
import os

import duckdb
import numpy as np
import pytest

from marlpit.plans import more  # noqa: F401  registers its queries
from marlpit.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: Queries whose order is part of the result.
ORDERED = ("order_limit_offset", "order_nulls", "json_order", "index_scan")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if name in ORDERED:
        assert got == want
    assert sorted(got, key=repr) == sorted(want, key=repr)


def check_rows(spark, d, name, table, rows):
    """The query and its SQL over a table of the given rows."""
    con = duckdb.connect()
    con.execute(f"COPY ({rows}) TO '{d}/{table}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet'")
    df = QUERIES[name](spark, str(d))
    want = [tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()]
    assert sorted([tuple(map(plain, r)) for r in df.collect()], key=repr) == sorted(want, key=repr)


def test_arithmetic_of_odd_prices(spark, tmp_path):
    prices = "unnest([NULL, '-5', '0', '-0.0', '2.5', 'nan', 'inf', '-inf']::DOUBLE[])"
    check_rows(spark, tmp_path, "arithmetic", "orders", f"SELECT *, (row_number() OVER () - 20)::BIGINT AS o_orderkey FROM (SELECT {prices} AS o_totalprice), (SELECT unnest([NULL, 0, 1, 2, 3, -1, -3]::BIGINT[]) AS o_custkey)")


def test_math_more_of_odd_numbers(spark, tmp_path):
    q, e, di = (f"unnest([{', '.join(f'{x!r}' if x else 'NULL' for x in v.split(','))}]::DOUBLE[])" for v in (",-0.5,0,1,2,nan,inf", ",0,-250,1,0.5,900.68,10000000000000056,inf", ",0,-0.0,0.05,1.5,nan"))
    check_rows(spark, tmp_path, "math_more", "lineitem", f"SELECT *, row_number() OVER () AS l_orderkey, 1 AS l_linenumber, 0.02::DOUBLE AS l_tax FROM (SELECT {q} AS l_quantity), (SELECT {e} AS l_extendedprice), (SELECT {di} AS l_discount)")
