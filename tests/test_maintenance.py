"""Upkeep steps against small models."""

from noesis.plans import maintenance as M


class Small:
    """A Store of given frames."""

    def __init__(self, spark, **tables):
        self.spark, self.tables = spark, tables

    def __call__(self, name, *columns):
        return self.tables[name].select(*columns) if columns else self.tables[name]

    def __getattr__(self, name):
        return self(name)


def test_entity_relations_of_hubs(spark):
    """Pairs and written-out hub members are all pairs of notes that share an entity, without existing edges."""
    holds = {1: range(60), 2: range(50, 110), 3: range(105, 112), 4: [7]}
    kinds = {1: " Tech", 2: None, 3: "concept", 4: "tech"}
    edges = [(0, 1), (58, 55), (105, 106), (50, 51)]
    links = [(n, e) for e, ns in holds.items() for n in ns]
    t = Small(
        spark,
        node_entities=spark.createDataFrame([*links, *links[:20], (3, 99), (None, 1)], "node_id long, entity_id long"),
        entities=spark.createDataFrame([(e, k) for e, k in kinds.items()], "id long, entity_type string"),
        edges=spark.createDataFrame(edges, "source_id long, target_id long"),
    )
    name = lambda e: "depends_on" if (kinds[e] or "").strip().lower() == "tech" else "related_to"
    want = {(a, b, name(e)) for e, ns in holds.items() for a in ns for b in ns if a < b and (a, b) not in edges}
    members = {tuple(r) for r in M.hub_relations(t).collect()}
    assert members == {(e, n, name(e)) for e in (1, 2) for n in holds[e]}
    got = [tuple(r) for r in M.entity_relations(t).unionByName(M.hub_pairs(t)).distinct().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    some = {tuple(r) for r in M.hub_pairs(t, spark.createDataFrame([(52,)], "id long")).collect()}
    assert some == {(a, b, k) for a, b, k in want if a == 52}


def test_run_twice_is_run_once(spark):
    """The whole batch on the smallest tables: every step runs, and a second run leaves the tables as they are, but for the
    factor of decay and what the logs gain."""
    import os

    import pytest
    from pyspark.sql import functions as F

    from noesis.plans import upkeep
    from noesis.plans.registry import Store

    base = "/root/testdata/sf0.001"
    if not os.path.isdir(base):
        pytest.skip("no test tables")
    t = Store(spark, base)
    now, steps = "2026-01-01 00:00:00", [n for n, _ in upkeep.steps() if n != "decay"]
    counts, state = upkeep.run(t, now=now, dry_run=False, only=steps)
    assert list(counts) == steps and -1 not in counts.values(), getattr(state, "errors", None)
    for name in ("relations", "boost", "contradictions", "anchors", "snapshot", "emergence", "mark", "topics", "kmeans", "chains"):
        assert counts[name] > 0, name
    edges, nodes = state.edges, state.nodes
    kinds = {r[0]: r[1] for r in edges.groupBy("edge_type").count().collect()}
    assert kinds["BELONGS_TO"] > 0 and kinds.get("GENERALIZES", 0) == kinds.get("INSTANTIATES", 0)
    pairs = {(r.source_id, r.target_id): r.weight for r in edges.filter("edge_type = 'CONTRADICTS' and created_at = timestamp '2026-01-01 00:00:00'").collect()}
    assert pairs and all((b, a) in pairs for a, b in pairs)
    old = edges.filter("edge_type = 'SUPERSEDES' and created_at = timestamp '2026-01-01 00:00:00'").select(F.col("target_id").alias("id"))
    assert nodes.join(old, "id", "left_semi").filter("importance = 'normal'").count() == 0
    assert nodes.groupBy("id").count().filter("count > 1").count() == 0
    again, twice = upkeep.run(state, now=now, dry_run=False, only=steps)
    assert -1 not in again.values(), getattr(twice, "errors", None)
    changed = {k: v for k, v in again.items() if v and k not in ("metrics", "orphans", "duplicates", "mark")}
    plain = lambda df: sorted(tuple(r) for r in df.select("id", "content", "category", "importance", "tags").collect() if r.category != "metrics-snapshot")
    assert plain(twice.nodes) == plain(nodes), changed
    key = ["source_id", "target_id", "edge_type"]
    assert twice.edges.select(*key).distinct().exceptAll(edges.select(*key).distinct()).count() == 0
    assert edges.select(*key).distinct().exceptAll(twice.edges.select(*key).distinct()).count() == 0


def test_relations_of_new_notes(spark):
    """Only notes since the last run are read; a pair with an edge of another type keeps it and is logged."""
    from noesis.plans import upkeep
    from noesis.plans.registry import Store

    class Says:
        def relations(self, texts):
            return [[("ann", "works_for", "acme", 0.9), ("ann", "uses", "nobody", 0.9)] if "ann" in t else [] for t in texts]

    state = upkeep.State(Store(spark, ""))
    stamp = "cast('{}' as timestamp)"
    state.own.update(
        nodes=spark.createDataFrame([(1, "ann at acme", "2025-01-05"), (2, "ann before", "2024-01-01"), (3, "x", "2025-02-01")], "id long, content string, timestamp string").selectExpr("id", "content", "cast(timestamp as timestamp) timestamp"),
        edges=spark.sql(f"select 1L source_id, 3L target_id, 0.5D weight, 'semantic' edge_type, {stamp.format('2025-01-01')} created_at"),
        entities=spark.createDataFrame([(1, "Ann"), (2, "ACME")], "id long, name string").selectExpr("id", "name", "'person' entity_type"),
        node_entities=spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "node_id long, entity_id long"),
        metadata=spark.createDataFrame([("last_sleep_at", "2025-01-01 00:00:00")], "key string, value string"),
    )
    counts, after = upkeep.run(state, now="2026-01-01 00:00:00", dry_run=False, only=["extraction"], extractor=Says())
    assert counts == {"extraction": 3}
    assert {(r.source_id, r.target_id, r.edge_type) for r in after.edges.collect()} == {(1, 3, "semantic"), (2, 3, "works_for"), (2, 1, "uses")}
    assert [(r.source_id, r.target_id, r.edge_type, r.existing_edge_type) for r in after("edge_history").collect()] == [(1, 3, "works_for", "semantic")]
    dry, same = upkeep.run(state, now="2026-01-01 00:00:00", only=["extraction"], extractor=Says())
    assert dry == counts and same.edges.count() == 1


def test_bounds_of_topics_and_links(spark, monkeypatch):
    assert [M.topic_count(n) for n in (10, 60, 600, 200_000)] == [3, 10, 20, 6666]
    seen = []
    monkeypatch.setattr(M.similarity, "similar_pairs", lambda notes, *a, least, **k: seen.append(least) or notes.selectExpr("id as a", "id as b", "1.0 as similarity").limit(0))
    M.thematic(Small(spark, nodes=spark.createDataFrame([(1, [1.0] * 128)], "id long, embedding array<float>")))
    assert seen == [0.75]
