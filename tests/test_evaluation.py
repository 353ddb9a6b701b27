"""Measures, logs, signals, indexes and the pair judge on small frames."""

import math

import numpy as np
from pyspark.sql import functions as F

from noesis.functions import plugins
from noesis.operators import evaluation as E
from noesis.operators import ranking, searchlog, signals, vector_index
from noesis.operators.similarity import similar_pairs


def test_recall_and_keywords(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1), (2, 13, 7)], "query_id long, node_id long, place int")
    wanted = spark.createDataFrame([(1, 11), (2, 13), (3, 10)], "query_id long, node_id long")
    judged = E.hits(found, wanted)
    assert {r.query_id: (r.rank, r.hit) for r in judged.collect()} == {1: (2, True), 2: (7, False), 3: (None, False)}
    row = {r.g: (r.queries, r.hits, round(r.recall, 4), round(r.mrr, 4)) for r in E.recall_and_rank(judged.withColumn("g", F.lit("a")), "g").collect()}
    assert row == {"a": (3, 1, 0.3333, round((1 / 2 + 1 / 7) / 3, 4)), "*": (3, 1, 0.3333, round((1 / 2 + 1 / 7) / 3, 4))}
    notes = spark.createDataFrame([(10, "The Night job"), (12, "other")], "id long, content string")
    keys = spark.createDataFrame([(1, ["night JOB", "x"]), (2, ["zz"]), (9, ["other"])], "query_id long, keywords array<string>")
    assert {r.query_id: r.hit for r in E.keyword_hits(found, notes, keys).collect()} == {1: True, 2: False, 9: False}
    expected = spark.createDataFrame([(1, 10, True), (2, 13, False), (3, 1, None)], "query_id long, node_id long, critical boolean")
    r = E.regression(found, expected).first()
    assert (r.hits, r.expected, r.critical_misses, r.passed) == (1, 3, 0, False)
    assert E.regression(found.limit(0), expected.limit(0)).first().precision == 0


def test_answers(spark):
    rows = [(1, "The cat sat", "the cat sat!"), (2, "a b b", "b b b c"), (3, None, "x"), (4, "", None)]
    got = {r.k: (round(r.f1, 4), round(r.rouge1, 4), r.exact) for r in E.answer_scores(spark.createDataFrame(rows, "k long, a string, t string"), "k", "a", "t").collect()}
    p, q = 2 / 3, 2 / 4
    assert got == {1: (1.0, 1.0, 1), 2: (round(2 * p * q / (p + q), 4), 0.5, 0), 3: (0.0, 0.0, 0), 4: (0.0, 0.0, 1)}


def test_questions(spark):
    notes = spark.createDataFrame([(1, "Yesterday the old Docker host failed again. Fine."), (2, "It rose to 45 % at once"), (3, "Plain words only here"), (4, "  ")], "id long, content string")
    links = spark.createDataFrame([(1, 5)], "node_id long, entity_id long")
    entities = spark.createDataFrame([(5, "docker", "tech")], "id long, name string, entity_type string")
    got = {r.id: (r.strategy, r.question) for r in E.questions(notes, links, entities).collect()}
    assert got == {1: ("entity", "Which tool or system: Yesterday the old [?] host failed again"), 2: ("keyword", "What does 45 % refer to?"), 3: ("sentence", "What is said about: Plain words only here")}


def test_log(spark, tmp_path):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, text string")
    found = spark.createDataFrame([(1, 7, 0.5, 1), (1, 8, 0.25, 2)], "query_id long, node_id long, score double, place int")
    searchlog.append(searchlog.log_rows(q, found, now="2025-01-02 03:00:00", timings={"ann": 3.0, "bm25": 1.0}), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert {(r.query, r.results_count, r.top5_scores) for r in log.collect()} == {("a", 2, "[0.5,0.25]"), ("b", 0, "[]")}
    s = searchlog.statistics(log, day="2025-01-02").first()
    assert (s.searches, s.zero_results, s.mean_top1, s.p50, s.mean_ann_ms, s.searches_ever) == (2, 1, 0.5, 4.0, 3.0, 2)
    assert [r.query for r in searchlog.zero_results(log).collect()] == ["b"]
    empty = searchlog.statistics(log, day="2020-01-01").first()
    assert (empty.searches, empty.p50) == (0, None)


def test_ranked_values_are_exact(spark):
    r = np.random.default_rng(3)
    rows = [(g, float(v)) for g in ("a", "b") for v in r.integers(0, 40, 501)] + [("c", 1.0), ("d", None)]
    got = {x.g: (x.p50, x.p95, x.most) for x in searchlog.ranked_values(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    want = {}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g)
        want[g] = (v[len(v) // 2], v[int(len(v) * 0.95)], v[-1])
    assert got == want


def test_boosts_pools_and_parents(spark):
    s = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.2), (1, 3, 0.4)], "query_id long, node_id long, score double")
    w = spark.createDataFrame([(1, 1, 0.9), (1, 8, 0.3), (1, 9, 0.05)], "query_id long, node_id long, score double")
    assert {r.node_id: round(r.score, 4) for r in ranking.boosted(s, w, by=0.15, least=0.1).collect()} == {1: 1.0, 2: 0.2, 3: 0.4, 8: 0.45}
    g = spark.createDataFrame([(2, 5), (3, 5)], "node_id long, grp long")
    assert {r.node_id: r.score for r in ranking.group_best(s, g).collect()} == {1: 0.9, 2: 0.4, 3: 0.4}
    kinds = spark.createDataFrame([(1, "atomic-fact"), (2, None), (3, "keyword-anchor"), (7, "abstract-topic")], "id long, category string")
    parents = spark.createDataFrame([(1, 2), (3, 7)], "id long, parent long")
    assert {r.node_id: r.score for r in ranking.whole_for_part(s, parents, kinds).collect()} == {2: 0.9}
    assert {r.node_id: round(r.score, 4) for r in ranking.between_ends(s).collect()} == {1: 1.0, 2: 0.0, 3: round(0.2 / 0.7, 4)}
    judged = ranking.reranked(s, spark.createDataFrame([(1, 1, 0.0), (1, 3, 4.0)], "query_id long, node_id long, score double"), weight=0.5, first=2)
    assert {r.node_id: round(r.score, 4) for r in judged.collect()} == {1: 0.45, 2: 0.2, 3: 0.7}


def test_many_queries_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(1)
    v = r.standard_normal((300, 16))
    v[7] = v[3]  # a tie
    base = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, embedding array<double>")
    q = base.filter("id < 30").withColumnRenamed("id", "query_id")
    few = {(x.query_id, x.node_id, round(x.score, 9)) for x in ranking.nearest(q, base, k=4, dim=16, least=-1).collect()}
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 8)
    many = {(x.query_id, x.node_id, round(x.score, 9)) for x in ranking.nearest(q, base, k=4, dim=16, least=-1).collect()}
    assert few == many and len(few) == 120


def test_similar_pairs_with_copies_and_sides(spark):
    r = np.random.default_rng(5)
    centre = r.standard_normal((60, 24))
    v = np.repeat(centre, 5, axis=0) + 0.3 * r.standard_normal((300, 24))
    v[10:60] = v[10]  # fifty copies
    rows = [(k, [float(x) for x in row], k % 2 == 0) for k, row in enumerate(v)] + [(900, None, True), (901, [0.0] * 24, False)]
    df = spark.createDataFrame(rows, "id long, e array<double>, side boolean")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if s[a, b] >= 0.8}
    for setting in ({}, {"cell": 40, "coarse": 4}, {"dense": 100}):
        got = [(x.a, x.b) for x in similar_pairs(df, "id", "e", least=0.8, dim=24, **setting).collect()]
        assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= 0.01 * len(want)
    two = {(x.a, x.b) for x in similar_pairs(df, "id", "e", least=0.8, dim=24, sides="side").collect()}
    assert two == {(a, b) for a, b in want if (a - b) % 2}
    assert similar_pairs(df.limit(0), "id", "e", least=0.8, dim=24).count() == 0


def test_stored_index(spark, tmp_path):
    r = np.random.default_rng(8)
    v = r.standard_normal((200, 12))
    frame = lambda lo, hi, m: spark.createDataFrame([(i, [float(x) for x in m[i - lo]]) for i in range(lo, hi)], "id long, embedding array<double>")
    path = str(tmp_path / "index")
    vector_index.build(frame(0, 200, v), path, dim=12, cell=40)
    vector_index.add(frame(200, 210, r.standard_normal((10, 12))), path)
    vector_index.add(spark.createDataFrame([(300, [1.0])], "id long, embedding array<double>"), path)
    assert vector_index.statistics(spark, path).first().vectors == 210
    q = frame(0, 5, v).withColumnRenamed("id", "query_id")
    got = {(x.query_id, x.node_id) for x in vector_index.search(spark, path, q, k=3, probe=99, least=-1).collect()}
    assert {(k, k) for k in range(5)} <= got and len(got) == 15
    fixed = vector_index.repaired(spark.createDataFrame([(1, "a b", None), (2, "c", [1.0] * 12)], "id long, content string, embedding array<float>"), plugins.encoded(plugins.HashingEncoder(12)), dim=12)
    assert {r.id: len(r.embedding) for r in fixed.collect()} == {1: 12, 2: 12}


def test_sparse(spark):
    d = spark.createDataFrame([(1, {"a": 1.0, "b": 0.05}), (2, {"a": 0.5, "c": 1.0})], "id long, w map<string,double>")
    got = [(r.doc, r.score) for r in vector_index.sparse_search(vector_index.sparse_index(d, "id", "w"), spark.createDataFrame([(9, {"a": 1.0})], "id long, w map<string,double>"), "id", "w").orderBy("place").collect()]
    assert got == [(1, 1.0), (2, 0.5)]


def test_signals(spark):
    edges = spark.createDataFrame([(1, 2, 1.0, "x"), (1, 3, 1.0, "x"), (2, 4, 1.0, "x"), (9, 9, 1.0, "x")], "source_id long, target_id long, weight double, edge_type string")
    nodes = spark.createDataFrame([(k, "general" if k < 9 else "lc-chunk", "learned" if k == 1 else "") for k in range(1, 11)], "id long, category string, content string")
    r = signals.hub_reach(edges, nodes, hubs=1).first()
    assert (r.reached, r.total) == (4, 8)
    assert signals.reflection(nodes).first().by_word == 1
    c = signals.convergence(edges, nodes, start=spark.createDataFrame([(4,)], "id long")).first()
    assert c.convergence == 1.0
    log = spark.createDataFrame([("2025-01-01", 1.0), ("2025-01-03", 4.0), ("2025-01-02", 2.0)], "timestamp string, v double")
    assert [r.change for r in signals.with_change(log, "v").orderBy("timestamp").collect()] == [None, 1.0, 2.0]
    t = signals.trend(log, "v").first()
    assert (t.runs, t.first, t.latest, t.least, t.most) == (3, 1.0, 4.0, 1.0, 4.0) and [r.v for r in signals.latest(log, 2).collect()] == [4.0, 2.0]


def test_plugins(spark):
    df = spark.createDataFrame([(1, "Docker and java on k8s"), (2, None)], "id long, content string")
    got = {(r.id, r.name, r.entity_type) for r in plugins.extracted(df, "id", "content", plugins.KnownEntities()).collect()}
    assert got == {(1, "Docker", "tech"), (1, "Java", "tech")}

    class Says:
        def relations(self, texts):
            return [[("a", "uses", "b", 0.9), ("a", "uses", "c", 0.1)] for _ in texts]

    assert [(r.head, r.relation, r.tail) for r in plugins.related(df.limit(1), "id", "content", Says()).collect()] == [("a", "uses", "b")]
    q = spark.createDataFrame([(5, "docker java")], "query_id long, text string")
    pairs = spark.createDataFrame([(5, 1), (5, 2)], "query_id long, node_id long")
    got = {r.node_id: round(r.score, 4) for r in plugins.judge(plugins.WordOverlap(), q, df)(pairs).collect()}
    assert got == {1: 0.4, 2: 0.0}
    v = plugins.HashingEncoder(32).encode(["a b", "a b", ""])
    assert np.allclose(v[0], v[1]) and math.isclose(np.linalg.norm(v[0]), 1.0) and not v[2].any()
