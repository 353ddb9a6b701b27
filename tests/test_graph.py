"""Graph operators against small sequential models."""

import random

from noesis.operators import graph
from noesis.operators.components import connected_components
from noesis.operators.joins import band_pairs, positions


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    got = {i: c for i, c in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leader_clusters(spark):
    r = random.Random(5)
    n = 120
    pairs = {(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(260)) if a < b} | {(200, 201), (201, 202)}
    near = {x: set() for x in [*range(n), 200, 201, 202]}
    for a, b in pairs:
        near[a].add(b)
    taken, want = set(), {}
    for x in sorted(near):
        if x not in taken:
            members = [x, *[y for y in near[x] if y not in taken]]
            taken |= set(members)
            if len(members) >= 3:
                want.update({m: x for m in members})
    notes = spark.createDataFrame([(x,) for x in near], "id long")
    got = dict(graph.leader_clusters(notes, spark.createDataFrame(list(pairs), "a long, b long")).collect())
    assert got == want and 202 not in got


def test_spread_ignores_edge_order_and_counts_both_ways(spark):
    e = [(1, 2, 0.5, "s"), (2, 1, 0.5, "s"), (2, 3, 0.4, "s"), (3, 4, -0.6, "CONTRADICTS")]
    seeds = spark.createDataFrame([(1, 1, 1.0)], "query_id long, node_id long, score double")
    run = lambda rows: {r.node_id: round(r.score, 9) for r in graph.spread(spark.createDataFrame(rows, "source_id long, target_id long, weight double, edge_type string"), seeds).collect()}
    assert run(e) == run(e[::-1])
    act = {1: 1.0}
    adj = [(s, t, w) for s, t, w, _ in e] + [(t, s, w) for s, t, w, _ in e]
    for _ in range(3):
        new = {}
        for x, a in act.items():
            if a >= 0.01:
                new[x] = new.get(x, 0) + a * 0.7
                for s, t, w in adj:
                    if s == x:
                        new[t] = new.get(t, 0) + a * w * 0.7
        top = max(new.values())
        act = {k: v / top for k, v in new.items()}
    assert run(e) == {k: round(v, 9) for k, v in act.items()}


def test_positions_and_bands(spark):
    df = spark.range(500).selectExpr("id", "pmod(id * 7919, 500) as k")
    got = {r.id: r.pos for r in positions(df, ["k"]).collect()}
    assert sorted(got.values()) == list(range(1, 501)) and all(got[i] == (i * 7919) % 500 + 1 for i in got)
    pairs = band_pairs(df, ["k"], 49, ["k"]).select("k", "k_b").collect()
    assert {(a, b) for a, b in pairs} == {(a, b) for a in range(500) for b in range(a + 1, min(500, a + 50))}


def test_cluster_links(spark):
    small = [(k, 1) for k in range(1, 5)]
    middle = [(k, 100) for k in range(100, 120)]
    large = [(k, 1000) for k in range(1000, 1060)]
    got = graph.cluster_links(spark.createDataFrame(small + middle + large, "id long, leader long")).collect()
    assert len([g for g in got if g.source_id < 100]) == 6 and len([g for g in got if 100 <= g.source_id < 1000]) == 19 and not [g for g in got if g.source_id >= 1000]


def test_ranks_and_communities_to_their_stopping_rule(spark):
    from collections import defaultdict

    import pytest

    from noesis.plans import graphs

    r = random.Random(8)
    rows = [(k, k + 1, 1.0, "s") for k in range(60)] + [(r.randrange(40), r.randrange(61), r.random(), "s") for _ in range(60)]
    df = spark.createDataFrame(rows, "source_id long, target_id long, weight double, edge_type string")
    store = lambda name, *columns: df.select(*columns)
    best = {}
    for a, b, w, _ in rows:
        best[a, b] = max(w, best.get((a, b), 0))
    total = defaultdict(float)
    for (a, _), w in best.items():
        total[a] += w
    ids = {x for e in best for x in e}
    n = len(ids)
    rank, rounds, moved = {x: 1 / n for x in ids}, 0, 1.0
    while moved >= n * 1e-4:
        loose = sum(v for x, v in rank.items() if x not in total)
        new = {x: 0.15 / n + 0.85 * loose / n for x in ids}
        for (a, b), w in best.items():
            new[b] += 0.85 * rank[a] * w / total[a]
        rank, moved, rounds = new, sum(abs(new[x] - rank[x]) for x in ids), rounds + 1
    assert rounds > 5
    got = {x.node_id: x.rank for x in graphs.g07c(store).collect()}
    assert got == pytest.approx({x: v / max(rank.values()) for x, v in rank.items()}, abs=2e-6)

    links = defaultdict(float)
    for a, b, w, _ in rows:
        if a != b:
            links[a, b] += w
            links[b, a] += w
    label = {a: a for a, _ in links}
    for rounds in range(1, 11):
        votes = {x: defaultdict(float, {label[x]: 1.0}) for x in label}
        for (a, b), w in links.items():
            votes[a][label[b]] += w
        new = {x: min((-round(w, 9), c) for c, w in v.items())[1] for x, v in votes.items()}
        moved, label = sum(new[x] != label[x] for x in label), new
        if moved * 1000 < len(label):
            break
    assert rounds > 2
    assert {x.node_id: x.community for x in graphs.g09c(store).collect()} == label
