"""The scan for nearest notes: exact, also by mapped blocks of queries, and without shuffling notes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from noesis.operators import ranking, vector_index


@pytest.fixture(scope="module")
def notes(spark):
    v = np.random.default_rng(4).standard_normal((700, 16))
    v[50:60] = v[40]
    return v, spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)] + [(900, [1.0]), (901, None), (902, [0.0] * 16)], "id long, embedding array<double>").repartition(3)


def brute(v, asked, k, least, without=frozenset()):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    return {(q, n) for q in asked for n in sorted((n for n in range(len(v)) if s[q, n] >= least and (q, n) not in without), key=lambda n: (-round(s[q, n], 12), n))[:k]}


def pairs(df):
    return {(r.query_id, r.node_id) for r in df.collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [4096, 20])
def test_blocks_of_queries(spark, notes, monkeypatch, block):
    v, base = notes
    monkeypatch.setattr(ranking, "QUERY_BLOCK", block)
    q = base.filter("id % 7 = 0").withColumnRenamed("id", "query_id")
    asked = range(0, 700, 7)
    for k, least in ((5, -1.0), (3, 0.4), (1000, 0.0)):
        got = ranking.nearest(q, base, k=k, dim=16, least=least)
        assert "CoGroups" not in plan(got) and pairs(got) == brute(v, asked, k, least)
    out = {(n, m) for n in asked for m in (n, n + 1, 3)}
    without = spark.createDataFrame(list(out), "query_id long, node_id long")
    assert pairs(ranking.nearest(q, base, k=5, dim=16, least=-1.0, without=without)) == brute(v, asked, 5, -1.0, out)
    every = ranking.nearest(q, base, k=ranking.ALL, dim=16, least=0.1)
    assert "Window" not in plan(every) and pairs(every) == brute(v, asked, 700, 0.1)


def test_identity_boost_as_by_join(spark, notes):
    _, base = notes
    base = base.filter("id < 300").withColumn("embedding", F.concat("embedding", F.array_repeat(F.lit(0.0), 112)))
    q, kinds = base.filter("id % 11 = 0").withColumnRenamed("id", "query_id"), base.filter("id % 3 = 0")
    near = ranking.nearest(q, base, k=6)
    want = ranking.boosted(near, ranking.nearest(q, kinds, k=ranking.ALL, least=0.0), by=0.15, least=0.1)
    got = ranking.boosted_nearest(q, near, kinds, by=0.15, least=0.1)
    of = lambda df: {(r.query_id, r.node_id): r.score for r in df.collect()}
    assert of(got) == pytest.approx(of(want), abs=1e-12) and got.count() == len(of(got))


def test_rounded_as_round(spark):
    x = [0.123449, 0.123451, -0.123451, 0.5, -0.00001, 0.0, 1.0, -7.77775001]
    df = spark.createDataFrame([(a,) for a in x], "score double")
    assert all(r.a == r.b for r in df.select(ranking.rounded("score").alias("a"), F.round("score", 4).alias("b")).collect())


def test_index_asked_in_all_cells_is_scanned(spark, notes, tmp_path):
    v, base = notes
    vector_index.build(base, str(tmp_path / "index"), dim=16, cell=50)
    q = base.filter("id % 7 = 0").withColumnRenamed("id", "query_id")
    search = lambda probe: vector_index.search(spark, str(tmp_path / "index"), q, k=5, probe=probe, least=-1.0)
    assert "CoGroups" not in plan(search(1 << 20)) and "CoGroups" in plan(search(1))
    got = {(r.query_id, r.node_id): r.score for r in search(1 << 20).collect()}
    assert len(got) == 500 and {p for p in got if 40 <= p[1] < 60} <= {p for p in brute(v, range(0, 700, 7), 16, -1.0)}
    assert {p for p in got if not 40 <= p[1] < 60} <= brute(v, range(0, 700, 7), 5, -1.0)
    vector_index.add(spark.createDataFrame([(3, v[7].tolist())], "id long, embedding array<double>"), str(tmp_path / "index"))
    again = {(r.query_id, r.node_id): r.score for r in search(1 << 20).collect()}
    assert again[7, 3] == pytest.approx(1.0) and (7, 3) not in got and vector_index.statistics(spark, str(tmp_path / "index")).first().vectors == 700
