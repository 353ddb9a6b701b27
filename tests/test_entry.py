"""Every query with SQL against DuckDB on the smallest tables; queries without SQL give rows."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
CORE = [n for n in entry.queries() if not n.startswith("p") or n.startswith(("p2_", "p5_"))]


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def table(columns):
    names = sorted(columns)
    return Counter(zip(*[[plain(v) for v in columns[n]] for n in names])) if names else Counter()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(BASE + "/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in CORE if n in entry.oracle_sql()])
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, BASE)
    want = duck.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.columns) == sorted(want.column_names)
    assert table(got.toArrow().to_pydict()) == table(want.to_pydict())


#: Queries without SQL whose result may be empty on the smallest tables; all others must give rows.
MAY_BE_EMPTY = {"m20_facts", "m20_fragments", "m18_topic_members", "m02_cluster_summaries", "g10_cluster_rank"}


@pytest.mark.parametrize("name", [n for n in CORE if n not in entry.oracle_sql()])
def test_runs(spark, name):
    df = entry.queries()[name](spark, BASE)
    n = df.count()
    assert df.columns and n == df.distinct().count() and (n > 0 or name in MAY_BE_EMPTY)
