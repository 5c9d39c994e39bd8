"""Every registered query against its SQL in DuckDB, row for row."""

import math
import os

import duckdb
import pytest

from tidemark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_equals_sql(spark, sf, db, name):
    ours = catalog.QUERIES[name](spark, sf)
    columns = sorted(ours.columns)
    theirs = db.sql(catalog.ORACLE_SQL[name])
    assert columns == sorted(theirs.columns)
    a = sorted(tuple(same(r[c]) for c in columns) for r in ours.collect())
    at = [theirs.columns.index(c) for c in columns]
    b = sorted(tuple(same(r[i]) for i in at) for r in theirs.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs_without_sql(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
