"""Every query of the dialect against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest
from lodeframe import workload

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    return c


def plain(rows):
    return sorted(repr([None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else str(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", list(workload.QUERIES))
def test_same_rows(spark, duck, name):
    df, want = workload.QUERIES[name](spark, DIR), duck.sql(workload.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_filters_reach_the_scan(spark):
    df = workload.QUERIES["filter_cmp"](spark, DIR)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_discount)" in text and "l_comment" not in text
