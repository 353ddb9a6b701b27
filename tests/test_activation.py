"""Spreading in tasks: the same as by joins, and nothing per query and note is shuffled."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from noesis.operators import graph, ranking

BASE = "/root/testdata/sf0.001"
KINDS = ["s", "TEMPORAL_BEFORE", "CONTRADICTS", "PART_OF"]


@pytest.fixture(scope="module")
def store(spark):
    r = random.Random(11)
    rows = [(r.randrange(80), r.randrange(80), round(r.uniform(-0.3, 1.0), 2), r.choice(KINDS)) for _ in range(260)] + [(200, k, 0.5, "s") for k in range(60)] + [(5, None, 0.5, "s"), (6, 7, None, "CONTRADICTS"), (7, 8, 0.0, "s")]
    edges = spark.createDataFrame(rows, "source_id long, target_id long, weight double, edge_type string")
    seeds = spark.createDataFrame([(q, n, s) for q in range(9) for n, s in {r.randrange(80): 1.0, r.randrange(80): 0.4, 999: 0.2}.items()], "query_id long, node_id long, score double")
    return edges, seeds


def near(a, b):
    x, y = ({(r.query_id, r.node_id): r.score for r in df.collect()} for df in (a, b))
    assert x.keys() == y.keys() and x == pytest.approx(y, abs=1e-12)


@pytest.mark.parametrize("options", [{}, {"rounds": 5, "floor": 0.2}, {"temporal_boost": 1.5}, {"normal": False}, {"allowed": 0}, {"community": 0, "inhibition": 0.8}, {"allowed": 0, "community": 0, "inhibition": 0.5, "temporal_boost": 2.0}])
def test_as_by_joins(spark, store, options):
    edges, seeds = store
    if "allowed" in options:
        options = options | {"allowed": seeds.select("query_id").distinct().join(spark.range(0, 300, 2).withColumnRenamed("id", "node_id"))}
    if "community" in options:
        options = options | {"community": spark.range(300).select(F.col("id").alias("node_id"), F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("id") % 7).cast("long").alias("community"))}
    near(graph.spread(edges, seeds, **options), graph.spread_joined(edges, seeds, **options))


def test_stretches_of_ends(spark, store, monkeypatch):
    """More ends than are multiplied at once; the tasks run here, so that the bound holds for them too."""
    from noesis.operators import activation

    edges, seeds = store
    links = graph.adjacency(edges).select("src", "dst", F.col("weight").alias("w")).filter("src is not null and dst is not null and w is not null")
    g = activation._graph(activation.lay_out(links, [seeds.select(F.col("node_id").alias("id"))]))
    live, a = g.ids % 3 > 0, g.ids / 100
    whole = g.push(live, a)
    for ends in (1, 7, 50):
        monkeypatch.setattr(activation, "ENDS", ends)
        got = g.push(live, a)
        assert got[0] == pytest.approx(whole[0]) and (got[1] == whole[1]).all()
    assert activation.lay_out(links.limit(0), []).notes == 0
    assert graph.spread(edges.limit(0), seeds).count() == seeds.count() and graph.spread(edges, seeds.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
@pytest.mark.parametrize("name", ["g01_spreading", "r12_blend", "r15_contradictions", "r19_whole_for_part", "x14_baseline_spreading"])
def test_no_shuffle_of_activations(spark, name):
    plan = entry.queries()[name](spark, BASE)._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("FlatMapGroupsInArrow")]
    assert not any(x in after for x in ("Join", "Exchange", "Aggregate", "Window"))
