"""Graph, index and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noesis import vocabulary as V
from noesis.operators import graph, joins, ranking, text_index
from noesis.operators.components import connected_components
from noesis.plans.registry import Catalog, Store

catalog = Catalog()
QUERIES, SQL = catalog.QUERIES, catalog.SQL
NOW = "2026-01-01 00:00:00"
EDGE = ("source_id", "target_id", "weight", "edge_type")

_ADJ = "adj AS (SELECT source_id AS src, target_id AS dst, weight AS w, edge_type FROM edges UNION ALL SELECT target_id, source_id, weight, edge_type FROM edges)"
_SEEDS = "act0 AS (SELECT id AS q, id AS v, 1.0::DOUBLE AS a FROM nodes WHERE category = 'breakthrough')"


def _rounds(n: int, boost: float = 1.0) -> str:
    w = f"CASE WHEN edge_type IN ('TEMPORAL_BEFORE', 'TEMPORAL_AFTER') THEN w * {boost} ELSE w END"
    return ", ".join(
        f"""sum{k} AS (SELECT q, v, sum(s) * 0.7 AS s FROM (SELECT q, v, a AS s FROM act{k} WHERE a >= 0.01 UNION ALL SELECT q, dst, a * {w} FROM act{k} JOIN adj ON src = v WHERE a >= 0.01) GROUP BY 1, 2),
        act{k + 1} AS (SELECT q, v, CASE WHEN max(s) OVER (PARTITION BY q) > 0 THEN s / max(s) OVER (PARTITION BY q) ELSE s END AS a FROM sum{k})"""
        for k in range(n)
    )


def seeds(t: Store) -> DataFrame:
    return t("nodes", "id", "category").filter("category = 'breakthrough'").select(F.col("id").alias("query_id"), F.col("id").alias("node_id"), F.lit(1.0).alias("score"))


@catalog("g01_spreading", f"WITH {_ADJ}, {_SEEDS}, {_rounds(3)} SELECT q AS query_id, v AS node_id, round(a, 4) AS score FROM act3")
def g01(t: Store) -> DataFrame:
    return graph.spread(t("edges", *EDGE), seeds(t)).withColumn("score", ranking.rounded("score"))


@catalog("g01_spreading_temporal", f"WITH {_ADJ}, {_SEEDS}, {_rounds(2, 1.5)} SELECT q AS query_id, v AS node_id, round(a, 4) AS score FROM act2")
def g01t(t: Store) -> DataFrame:
    return graph.spread(t("edges", *EDGE), seeds(t), rounds=2, temporal_boost=1.5).withColumn("score", ranking.rounded("score"))


@catalog("g02_subgraph", f"WITH {_ADJ}, {_SEEDS} SELECT q AS query_id, v AS node_id FROM act0 UNION SELECT q, dst FROM act0 JOIN adj ON src = v")
def g02(t: Store) -> DataFrame:
    return graph.subgraph(t("edges", *EDGE), seeds(t))


_PR = """e AS (SELECT source_id AS src, target_id AS dst, max(weight) AS w FROM edges GROUP BY 1, 2 HAVING max(weight) > 0), tot AS (SELECT src, sum(w) AS t FROM e GROUP BY 1),
    p AS (SELECT src, dst, w / t AS p FROM e JOIN tot USING (src)), v AS (SELECT src AS id FROM p UNION SELECT dst FROM p), n AS (SELECT count(*)::DOUBLE AS n FROM v), r0 AS (SELECT id, 1 / n AS r FROM v, n), """ + ", ".join(
    f"""l{k} AS (SELECT coalesce(sum(r), 0) AS l FROM r{k} WHERE id NOT IN (SELECT src FROM tot)),
    r{k + 1} AS (SELECT v.id, 0.15 / any_value(n) + 0.85 * (coalesce(sum(r * p), 0) + any_value(l) / any_value(n)) AS r FROM v CROSS JOIN n CROSS JOIN l{k} LEFT JOIN p ON p.dst = v.id LEFT JOIN r{k} x ON x.id = p.src GROUP BY v.id)"""
    for k in range(5)
)


@catalog("g07_pagerank", f"WITH {_PR} SELECT id AS node_id, round(r / (SELECT max(r) FROM r5), 6) AS rank FROM r5")
def g07(t: Store) -> DataFrame:
    return graph.pagerank(t("edges", *EDGE), rounds=5, tolerance=0.0).withColumn("rank", F.round("rank", 6))


@catalog("g07_pagerank_converged")
def g07c(t: Store) -> DataFrame:
    """PageRank to its stopping rule; ``g07_pagerank`` is its first five rounds, for comparison with SQL."""
    return graph.pagerank(t("edges", *EDGE)).withColumn("rank", F.round("rank", 6))


@catalog(
    "g08_components",
    """WITH RECURSIVE a AS (SELECT source_id AS u, target_id AS v FROM edges WHERE source_id <> target_id UNION SELECT target_id, source_id FROM edges WHERE source_id <> target_id),
    r(id, c) AS (SELECT u, u FROM a UNION SELECT a.v, r.c FROM r JOIN a ON a.u = r.id) SELECT id, min(c) AS component FROM r GROUP BY 1""",
)
def g08(t: Store) -> DataFrame:
    return connected_components(t("edges", *EDGE), "source_id", "target_id")


_LP = """k AS (SELECT src, dst, sum(w) AS w FROM adj WHERE w > 0 AND src <> dst GROUP BY 1, 2), lab0 AS (SELECT DISTINCT src AS id, src AS label FROM k), """ + ", ".join(
    f"""vt{n} AS (SELECT id, label, round(sum(w), 9) AS w FROM (SELECT k.src AS id, l.label, k.w FROM k JOIN lab{n} l ON l.id = k.dst UNION ALL SELECT id, label, 1.0 FROM lab{n}) GROUP BY 1, 2),
    lab{n + 1} AS (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY w DESC, label) AS r FROM vt{n}) WHERE r = 1)"""
    for n in range(2)
)


@catalog("g09_communities", f"WITH {_ADJ}, {_LP} SELECT id AS node_id, label AS community FROM lab2")
def g09(t: Store) -> DataFrame:
    return graph.communities(t("edges", *EDGE), rounds=2)


@catalog("g09_communities_converged")
def g09c(t: Store) -> DataFrame:
    """Communities to their stopping rule; ``g09_communities`` is the first two rounds, for comparison with SQL."""
    return graph.communities(t("edges", *EDGE))


@catalog("g05_leader_clusters")
def g05(t: Store) -> DataFrame:
    return leaders(t)


def leaders(t: Store) -> DataFrame:
    e = t("edges", *EDGE).filter("edge_type in ('consolidation', 'semantic') and weight >= 0.7 and source_id <> target_id")
    pairs = e.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"))
    notes = t("nodes", "id")
    known = pairs.join(notes.withColumnRenamed("id", "a"), "a", "left_semi").join(notes.withColumnRenamed("id", "b"), "b", "left_semi")
    return graph.leader_clusters(notes, known)


@catalog("g06_cluster_links")
def g06(t: Store) -> DataFrame:
    return graph.cluster_links(leaders(t))


_SELF = ", ".join(f"'{c}'" for c in V.SELF_MODEL)


@catalog(
    "g12_density",
    f"""WITH m AS (SELECT id FROM nodes WHERE category IN ({_SELF})), i AS (SELECT count(*) AS internal FROM edges WHERE source_id IN (SELECT id FROM m) AND target_id IN (SELECT id FROM m)), c AS (SELECT count(*) AS members FROM m)
    SELECT members, internal, round(CASE WHEN members >= 5 THEN tanh(internal / greatest(members * (members - 1), 1) * 20) ELSE 0.0 END, 6) AS density FROM i, c""",
)
def g12(t: Store) -> DataFrame:
    return graph.density(t("edges", *EDGE), t("nodes", "id", "category").filter(F.col("category").isin(V.SELF_MODEL))).withColumn("density", F.round("density", 6))


@catalog("g13_cross_category", "SELECT count(*) AS crossing, round(avg(weight), 6) AS mean_weight FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE a.category <> b.category")
def g13(t: Store) -> DataFrame:
    c = t("nodes", "id", "category").filter("category is not null").select(F.col("id").alias("node_id"), F.xxhash64("category").alias("community"))
    return graph.cross_community(t("edges", *EDGE), c).withColumn("mean_weight", F.round("mean_weight", 6))


@catalog(
    "g17_temporal_continuity",
    """WITH e AS (SELECT source_id FROM edges WHERE edge_type IN ('TEMPORAL_BEFORE', 'TEMPORAL_AFTER', 'temporal_chain')), n AS (SELECT count(*) AS n FROM nodes)
    SELECT round(((SELECT count(DISTINCT source_id) FROM e) / n::DOUBLE + tanh((SELECT count(*) FROM e) / n::DOUBLE)) / 2, 6) AS continuity FROM n""",
)
def g17(t: Store) -> DataFrame:
    e = t("edges", "source_id", "edge_type").filter(F.col("edge_type").isin(*V.TEMPORAL_EDGES, "temporal_chain")).agg(F.count(F.lit(1)).alias("m"), F.countDistinct("source_id").alias("s"))
    n = t("nodes", "id").agg(F.count(F.lit(1)).alias("n"))
    return e.crossJoin(n).select(F.round((F.col("s") / F.col("n") + F.tanh(F.col("m") / F.col("n"))) / 2, 6).alias("continuity"))


@catalog("a22_cluster_phi", "SELECT round(CASE WHEN count(*) < 2 THEN 0.0 ELSE (least(1.0, sum(cluster_size) / (SELECT count(*) FROM nodes)) + tanh(count(*) / 20.0)) / 2 END, 6) AS phi FROM cluster_summaries")
def a22(t: Store) -> DataFrame:
    c = t("cluster_summaries", "cluster_size").agg(F.count(F.lit(1)).alias("k"), F.sum("cluster_size").alias("s")).crossJoin(t("nodes", "id").agg(F.count(F.lit(1)).alias("n")))
    return c.select(F.round(F.when(F.col("k") < 2, 0.0).otherwise((F.least(F.lit(1.0), F.col("s") / F.col("n")) + F.tanh(F.col("k") / 20.0)) / 2), 6).alias("phi"))


@catalog(
    "x07_bm25",
    """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Zа-яА-ЯёЁ0-9_]+') AS t FROM documents WHERE text IS NOT NULL), dl AS (SELECT doc_id, len(t) AS dl FROM d WHERE len(t) > 0),
    c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-zA-Zа-яА-ЯёЁ0-9_]+')) AS term FROM eval_items) GROUP BY 1, 2),
    s AS (SELECT item_id, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN dl USING (doc_id) CROSS JOIN c GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM s WHERE score > 0)
    SELECT item_id AS query, doc_id AS doc, round(score, 4) AS score, place::INTEGER AS place FROM r WHERE place <= 5""",
)
def x07(t: Store) -> DataFrame:
    out = text_index.bm25(t("documents", "doc_id", "text"), "doc_id", "text", t("eval_items", "item_id", "text"), "item_id", "text", top=5)
    return out.select("query", "doc", F.round("score", 4).alias("score"), "place")


@catalog(
    "m02_category_terms",
    """WITH w AS (SELECT category AS cluster, unnest(regexp_extract_all(lower(content), '[a-zA-Zа-яА-ЯёЁ0-9_]+')) AS term FROM nodes WHERE category IS NOT NULL), c AS (SELECT cluster, term, count(*) AS c FROM w WHERE length(term) > 1 GROUP BY 1, 2),
    l AS (SELECT cluster, sum(c) AS length FROM c GROUP BY 1), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM l),
    s AS (SELECT cluster, term, round((c / length) * (ln((n + 1) / (df + 1)) + 1), 9) AS weight FROM c JOIN l USING (cluster) JOIN f USING (term) CROSS JOIN n)
    SELECT cluster, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS r FROM s) WHERE r <= 15""",
)
def m02(t: Store) -> DataFrame:
    return text_index.cluster_tfidf(t("nodes", "id", "category", "content"), "id", "category", "content").withColumn("weight", F.round("weight", 6))


_UNIT = "SELECT id, category, [x / sqrt(list_sum([y::DOUBLE * y FOR y IN embedding])) FOR x IN embedding]::DOUBLE[128] AS v FROM nodes WHERE len(embedding) = 128 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0"
_KNN = f"""u AS ({_UNIT}), knn AS (SELECT q, v, s FROM (SELECT a.id AS q, b.id AS v, array_inner_product(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.id ORDER BY array_inner_product(a.v, b.v) DESC, b.id) AS r FROM u a JOIN u b ON a.category = 'breakthrough') WHERE r <= 15 AND s >= 0)"""


def knn(t: Store) -> DataFrame:
    q = t("nodes", "id", "category", "embedding").filter("category = 'breakthrough'").select(F.col("id").alias("query_id"), "embedding")
    return ranking.nearest(q, t("nodes", "id", "embedding"), k=15)


@catalog("x03_nearest", f"WITH {_KNN} SELECT q AS query_id, v AS node_id, round(s, 4) AS score FROM knn")
def x03(t: Store) -> DataFrame:
    return knn(t).withColumn("score", F.round("score", 4))


_SLOW = " ".join(f"WHEN category = '{c}' THEN {f}" for c, f in V.DECAY_FACTORS.items())
_WEIGHT = f"""weight AS (SELECT id, CASE WHEN category = 'anchor' THEN 1.0 WHEN moment IS NULL THEN 0.5 WHEN f < 1 THEN greatest(0.1, 1 - (1 - base) * f) ELSE base END AS recency,
    CASE importance WHEN 'critical' THEN 1.5 WHEN 'low' THEN 0.7 ELSE 1.0 END + least(0.2, coalesce(access_count, 0) * 0.01) AS importance
    FROM (SELECT *, CASE {_SLOW} ELSE 1.0 END AS f, greatest(0.1, pow(0.5, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(moment)) / 86400000000.0) / 30.0)) AS base FROM (SELECT *, coalesce(last_accessed, timestamp) AS moment FROM nodes)))"""


def note_weights(t: Store) -> DataFrame:
    n = t("nodes", "id", "category", "importance", "access_count", "last_accessed", "timestamp")
    return n.select("id", ranking.recency(F.col("last_accessed"), F.col("timestamp"), F.col("category"), NOW).alias("recency"), ranking.importance(F.col("importance"), F.col("access_count")).alias("importance"))


@catalog("r08_recency_importance", f"WITH {_WEIGHT} SELECT id, round(recency, 6) AS recency, round(importance::DOUBLE, 6) AS importance FROM weight")
def r08(t: Store) -> DataFrame:
    return note_weights(t).select("id", F.round("recency", 6).alias("recency"), F.round("importance", 6).alias("importance"))


@catalog(
    "r10_temporal_overlap",
    """WITH e AS (SELECT id, epoch_us(t_event_start) / 1e6 AS a, epoch_us(t_event_end) / 1e6 AS b, epoch_us(TIMESTAMP '2024-01-01') / 1e6 AS c, epoch_us(TIMESTAMP '2024-07-01') / 1e6 AS d FROM nodes WHERE t_event_start IS NOT NULL AND t_event_end IS NOT NULL)
    SELECT id, round(CASE WHEN least(b, d) - greatest(a, c) > 0 THEN least(1.0, (least(b, d) - greatest(a, c)) / (d - c)) ELSE 0.0 END, 6) AS share FROM e""",
)
def r10(t: Store) -> DataFrame:
    n = t("nodes", "id", "t_event_start", "t_event_end").filter("t_event_start is not null and t_event_end is not null")
    lit = lambda s: F.lit(s).cast("timestamp")
    return n.select("id", F.round(ranking.overlap(F.col("t_event_start"), F.col("t_event_end"), lit("2024-01-01"), lit("2024-07-01")), 6).alias("share"))


_BLEND = f"""{_ADJ}, {_SEEDS}, {_rounds(3)}, {_KNN}, w AS (SELECT q, v, s * 0.6 AS s FROM knn UNION ALL SELECT q, v, a * 0.4 FROM act3), blended AS (SELECT q, v, sum(s) AS s FROM w GROUP BY 1, 2)"""


def blended(t: Store, *, contradictions: bool = False) -> DataFrame:
    return graph.spread(t("edges", *EDGE), seeds(t), blend=(knn(t), 0.6, 0.4), contradictions=contradictions)


@catalog("r12_blend", f"WITH {_BLEND} SELECT q AS query_id, v AS node_id, round(s, 4) AS score FROM blended")
def r12(t: Store) -> DataFrame:
    return blended(t).withColumn("score", ranking.rounded("score"))


@catalog(
    "r13_reciprocal_ranks",
    f"""WITH {_KNN}, d AS (SELECT source_id AS q, target_id AS v, max(weight) AS s FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE category = 'breakthrough') GROUP BY 1, 2),
    p AS (SELECT q, v, 1.0 / (60 + row_number() OVER (PARTITION BY q ORDER BY s DESC, v)) AS s FROM knn WHERE s > 0 UNION ALL SELECT q, v, 1.0 / (60 + row_number() OVER (PARTITION BY q ORDER BY s DESC, v)) FROM d WHERE s > 0)
    SELECT q AS query_id, v AS node_id, round(sum(s), 6) AS score FROM p GROUP BY 1, 2""",
)
def r13(t: Store) -> DataFrame:
    linked = t("edges", *EDGE).join(seeds(t).select(F.col("node_id").alias("source_id")), "source_id", "left_semi").groupBy(F.col("source_id").alias("query_id"), F.col("target_id").alias("node_id")).agg(F.max("weight").alias("score"))
    return ranking.reciprocal_ranks([knn(t), linked]).withColumn("score", F.round("score", 6))


@catalog(
    "r14_hub_penalty",
    f"""WITH {_KNN}, n AS (SELECT node_id, count(DISTINCT entity_id) AS n FROM node_entities GROUP BY 1) SELECT q AS query_id, v AS node_id, round(CASE WHEN n > 3 THEN s * 3 / n ELSE s END, 4) AS score FROM knn LEFT JOIN n ON node_id = v""",
)
def r14(t: Store) -> DataFrame:
    return ranking.hub_penalty(knn(t), t.node_entities, most=3).select("query_id", "node_id", F.round("score", 4).alias("score"))


@catalog(
    "r15_contradictions",
    f"""WITH {_BLEND}, c AS (SELECT DISTINCT src, dst FROM adj WHERE edge_type = 'CONTRADICTS'), hit AS (SELECT DISTINCT b.q, c.src AS v FROM blended b JOIN c ON c.dst = b.v WHERE b.s > 0.3)
    SELECT b.q AS query_id, b.v AS node_id, round(CASE WHEN h.v IS NOT NULL THEN s * 0.3 ELSE s END, 4) AS score FROM blended b LEFT JOIN hit h ON h.q = b.q AND h.v = b.v""",
)
def r15(t: Store) -> DataFrame:
    return blended(t, contradictions=True).withColumn("score", ranking.rounded("score"))


@catalog(
    "r16_lateral_inhibition",
    f"""WITH {_KNN}, r AS (SELECT q, v, s, c.category, row_number() OVER (PARTITION BY q, c.category ORDER BY s DESC, v) AS r FROM knn LEFT JOIN nodes c ON c.id = v)
    SELECT q AS query_id, v AS node_id, round(CASE WHEN category IS NOT NULL AND r > 1 THEN s * 0.7 ELSE s END, 4) AS score FROM r""",
)
def r16(t: Store) -> DataFrame:
    c = t("nodes", "id", "category").filter("category is not null").select(F.col("id").alias("node_id"), F.xxhash64("category").alias("community"))
    return graph.inhibit(knn(t), c, 0.3).select("query_id", "node_id", F.round("score", 4).alias("score"))


@catalog(
    "r17_part_inhibition",
    f"""WITH {_KNN}, p AS (SELECT source_id AS id, min(target_id) AS parent FROM edges WHERE edge_type = 'PART_OF' GROUP BY 1), r AS (SELECT q, v, s, parent, row_number() OVER (PARTITION BY q, parent ORDER BY s DESC, v) AS r FROM knn LEFT JOIN p ON p.id = v)
    SELECT q AS query_id, v AS node_id, round(CASE WHEN parent IS NOT NULL AND r > 1 THEN s * 0.4 ELSE s END, 4) AS score FROM r""",
)
def r17(t: Store) -> DataFrame:
    p = t("edges", *EDGE).filter("edge_type = 'PART_OF'").groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("parent"))
    return ranking.part_inhibition(knn(t), p).select("query_id", "node_id", F.round("score", 4).alias("score"))


@catalog("r21_search")
def search(t: Store) -> DataFrame:
    """Retrieval: seeds, routed spreading with late inhibition, BM25, recency and importance, blend, penalties, inhibition by
    community and by part, top 10; without what ``retrieval.search`` lists as not done."""
    q = t("nodes", "id", "category", "content", "embedding").filter("category = 'breakthrough'")
    from noesis.plans.retrieval import search as run

    return run(t, q.select(F.col("id").alias("query_id"), F.col("content").alias("text"), "embedding"), now=NOW).select("query_id", "node_id", "place", F.round("score", 6).alias("score"))
