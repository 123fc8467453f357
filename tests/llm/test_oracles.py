"""Every query of this folder that has SQL gives DuckDB's rows at the smallest scale."""

import os

import duckdb
import pytest

from tallyweave.llm import queries
from tests.test_oracles import plain

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the stored tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        duck.sql(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    frame = queries.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    told = duck.sql(queries.ORACLE_SQL[name])
    at = [list(told.columns).index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in told.fetchall()), key=repr)
