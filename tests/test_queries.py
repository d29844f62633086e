"""Every registered query against its SQL on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from quire.plans import queries as plans

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
# The library's own queries; those of the optional subpackage have tests beside it.
QUERIES = {name: query for name, query in entry_point.queries().items() if name in plans.QUERIES}
ORACLES = plans.ORACLES

pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{BASE}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) == set(plans.QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, BASE)
    result = db.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    at = [columns.index(c) for c in df.columns]
    want = sorted((repr(tuple(r[i] for i in at)) for r in result.fetchall()))
    got = sorted(repr(tuple(r)) for r in df.collect())
    assert got == want


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0 and "items" in df.columns
