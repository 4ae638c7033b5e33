"""Queries that SQL can express, against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest
from lodeframe.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.SQL))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for t in glob.glob(f"{DIR}/*.parquet"):
        duck.sql(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    got, want = registry.QUERIES[name](spark, DIR), duck.sql(registry.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(want.select(*columns).fetchall())
