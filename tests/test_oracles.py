"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import datetime
import decimal
import os

import duckdb
import numpy as np
import pytest

from tallyweave.plans import catalog, fixtures

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the stored tables")


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in value)
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (float, decimal.Decimal, np.floating)):
        return None if value != value else round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in fixtures.STORED:
        connection.sql(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    frame = catalog.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    told = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(told.columns) == columns
    at = [list(told.columns).index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in told.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).limit(1).columns
