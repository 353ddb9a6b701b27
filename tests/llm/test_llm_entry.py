"""Queries of the training-data operators against DuckDB on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from noesis.llm import queries

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return v


def table(columns):
    names = sorted(columns)
    return Counter(zip(*[[plain(v) for v in columns[n]] for n in names]))


@pytest.mark.parametrize("name", list(queries.SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(BASE + "/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, BASE)
    want = c.sql(queries.SQL[name]).to_arrow_table()
    assert sorted(got.columns) == sorted(want.column_names)
    assert table(got.toArrow().to_pydict()) == table(want.to_pydict())


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, BASE)
    n = df.count()
    assert n == df.distinct().count()
