"""Queries of retrieval steps, measures, signals, logs and indexes."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noesis import vocabulary as V
from noesis.operators import evaluation, graph, ranking, searchlog, signals, vector_index
from noesis.plans import graphs, relational
from noesis.plans.graphs import _ADJ, _BLEND, _KNN, _PR, _SEEDS, EDGE, NOW, knn, seeds
from noesis.plans.registry import Catalog, Store
from noesis.session import cut, shared_dir

catalog = Catalog()
QUERIES, SQL = catalog.QUERIES, catalog.SQL
_list = lambda names: ", ".join(f"'{n}'" for n in names)


def _parents(t: Store) -> DataFrame:
    return relational.j16(t)


@catalog("f01_category_after_ranking", f"WITH {_KNN}, r AS (SELECT q, v, s, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, v) AS r FROM knn JOIN nodes n ON n.id = v WHERE category = 'breakthrough') SELECT q AS query_id, v AS node_id, round(s, 4) AS score FROM r WHERE r <= 3")
def f01(t: Store) -> DataFrame:
    """The category counts after ranking among all notes and before the limit."""
    kept = knn(t).join(t("nodes", F.col("id").alias("node_id"), "category").filter("category = 'breakthrough'").select("node_id"), "node_id", "left_semi")
    return ranking.top(kept, 3).select("query_id", "node_id", F.round("score", 4).alias("score"))


@catalog(
    "g03_routed",
    f"""WITH {_ADJ}, {_SEEDS}, sub AS (SELECT q, v FROM act0 UNION SELECT q, dst FROM act0 JOIN adj ON src = v), own AS (SELECT DISTINCT q, category FROM act0 JOIN nodes ON id = v WHERE category IS NOT NULL),
    inside AS (SELECT DISTINCT q, n.id AS v FROM own JOIN nodes n USING (category)), near AS (SELECT q, v FROM inside UNION SELECT q, dst FROM inside JOIN adj ON src = v)
    SELECT q AS query_id, v AS node_id FROM sub WHERE (q, v) IN (SELECT (q, v) FROM near) OR q NOT IN (SELECT q FROM own)""",
)
def g03(t: Store) -> DataFrame:
    c = t("nodes", "id", "category").filter("category is not null").select(F.col("id").alias("node_id"), F.xxhash64("category").alias("community"))
    return graph.route(t("edges", *EDGE), seeds(t), c)


@catalog("a07_part_pooling", f"WITH {_KNN}, p AS (SELECT source_id AS id, min(target_id) AS parent FROM edges WHERE edge_type = 'PART_OF' GROUP BY 1) SELECT q AS query_id, v AS node_id, round(CASE WHEN parent IS NOT NULL THEN max(s) OVER (PARTITION BY q, parent) ELSE s END, 4) AS score FROM knn LEFT JOIN p ON p.id = v")
def a07(t: Store) -> DataFrame:
    groups = _parents(t).select(F.col("id").alias("node_id"), F.col("parent").alias("grp"))
    return ranking.group_best(knn(t), groups).withColumn("score", F.round("score", 4))


@catalog("w04_between_ends", f"WITH {_KNN}, e AS (SELECT *, min(s) OVER (PARTITION BY q) AS a, max(s) OVER (PARTITION BY q) AS b FROM knn) SELECT q AS query_id, v AS node_id, round(CASE WHEN b > a THEN (s - a) / (b - a) ELSE 0.5 END, 4) AS score FROM e")
def w04(t: Store) -> DataFrame:
    return ranking.between_ends(knn(t)).withColumn("score", F.round("score", 4))


_WANTED = f"wanted AS (SELECT a.id AS q, b.id AS v, array_inner_product(a.v, b.v) AS s FROM u a JOIN u b ON a.category = 'breakthrough' AND b.category IN ({_list(V.IDENTITY_BOOSTED)}) WHERE array_inner_product(a.v, b.v) >= 0)"


@catalog(
    "r04_identity_boost",
    f"""WITH {_KNN}, {_WANTED} SELECT coalesce(k.q, w.q) AS query_id, coalesce(k.v, w.v) AS node_id, round(CASE WHEN w.s IS NULL THEN k.s WHEN k.s IS NOT NULL THEN least(1.0, k.s + 0.15) ELSE w.s + 0.15 END, 4) AS score
    FROM knn k FULL JOIN wanted w ON w.q = k.q AND w.v = k.v WHERE k.s IS NOT NULL OR w.s >= 0.1""",
)
def r04(t: Store) -> DataFrame:
    """Notes that tell of identity raised among the nearest, and brought in from a similarity of 0.1 on."""
    notes = t("nodes", "id", "category", "embedding")
    asked = notes.filter("category = 'breakthrough'").select(F.col("id").alias("query_id"), "embedding")
    kinds = notes.filter(F.col("category").isin(V.IDENTITY_BOOSTED)).select("id", "embedding")
    return ranking.boosted_nearest(asked, cut(knn(t), "near"), kinds, by=0.15, least=0.1).withColumn("score", ranking.rounded("score"))


@catalog(
    "r11_temporal_order",
    f"""WITH {_KNN}, d AS (SELECT q, v, epoch_us(timestamp) AS t, CASE q % 3 WHEN 0 THEN 'before' WHEN 1 THEN 'after' ELSE 'when' END AS direction FROM knn JOIN nodes n ON n.id = v),
    e AS (SELECT *, min(t) OVER (PARTITION BY q) AS a, max(t) OVER (PARTITION BY q) AS b FROM d)
    SELECT q AS query_id, v AS node_id, round(CASE WHEN t IS NULL THEN 0.0 WHEN a = b THEN 0.5 WHEN direction = 'before' THEN 1.0 - (t - a) / (b - a)::DOUBLE WHEN direction = 'after' THEN (t - a) / (b - a)::DOUBLE ELSE 0.5 END, 4) AS score FROM e""",
)
def r11(t: Store) -> DataFrame:
    way = F.element_at(F.array(F.lit("before"), F.lit("after"), F.lit("when")), (F.col("query_id") % 3 + 1).cast("int"))
    rows = knn(t).join(t("nodes", F.col("id").alias("node_id"), F.col("timestamp").alias("at")), "node_id").withColumn("direction", way)
    return ranking.temporal_place(rows).withColumn("score", F.round("score", 4))


@catalog(
    "r18_reranked",
    f"""WITH {_KNN}, p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, v) AS r FROM knn), j AS (SELECT q, v, s, length(content)::DOUBLE AS x FROM p JOIN nodes ON id = v WHERE r <= 5),
    e AS (SELECT *, min(x) OVER (PARTITION BY q) AS a, max(x) OVER (PARTITION BY q) AS b FROM j)
    SELECT q AS query_id, v AS node_id, round(s * 0.7 + 0.3 * CASE WHEN b > a THEN (x - a) / (b - a) ELSE 0.5 END, 4) AS score FROM e UNION ALL SELECT q, v, round(s, 4) FROM p WHERE r > 5""",
)
def r18(t: Store) -> DataFrame:
    """The five best judged anew, here by the length of their content."""
    judged = knn(t).join(t("nodes", F.col("id").alias("node_id"), F.length("content").cast("double").alias("x")), "node_id").select("query_id", "node_id", F.col("x").alias("score"))
    return ranking.reranked(knn(t), judged, weight=0.3, first=5).withColumn("score", F.round("score", 4))


_PARTS = "p AS (SELECT source_id AS id, min(target_id) AS parent FROM edges WHERE edge_type = 'PART_OF' GROUP BY 1)"


@catalog(
    "r19_whole_for_part",
    f"""WITH {_ADJ}, {_SEEDS}, {graphs._rounds(2)}, {_PARTS}, x AS (SELECT q, v, a AS s, category FROM act2 JOIN nodes ON id = v WHERE category IS NULL OR category <> 'abstract-topic'), f AS (SELECT *, coalesce(category IN ({_list(V.FRAGMENTS)}), false) AS part FROM x),
    y AS (SELECT q, v, s FROM f WHERE NOT part UNION ALL SELECT q, parent, s FROM f JOIN p ON p.id = v JOIN nodes n ON n.id = parent WHERE part AND (n.category IS NULL OR n.category NOT IN ('abstract-topic', 'atomic-fact', 'enriched-fragment')))
    SELECT q AS query_id, v AS node_id, round(max(s), 4) AS score FROM y GROUP BY 1, 2""",
)
def r19(t: Store) -> DataFrame:
    whole = ranking.folds(_parents(t), t("nodes", "id", "category"))
    return graph.spread(t("edges", *EDGE), seeds(t), rounds=2, fold=whole).withColumn("score", ranking.rounded("score"))


@catalog(
    "r21_shown",
    f"""WITH {_KNN}, r AS (SELECT q, v, s, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, v) AS place, count(*) OVER (PARTITION BY q) AS n FROM knn),
    l AS (SELECT *, split_part(content, chr(10), 1) AS line FROM r JOIN nodes ON id = v WHERE place <= 4)
    SELECT q AS query_id, place::INTEGER AS place, v AS node_id, round(s, 4) AS score, category, importance, CASE WHEN length(line) > 150 THEN substring(line, 1, 147) || '...' ELSE line END AS shown,
    (length(CASE WHEN length(line) > 150 THEN substring(line, 1, 147) || '...' ELSE line END) // 4)::BIGINT AS tokens, n > 4 AS has_more FROM l""",
)
def r21(t: Store) -> DataFrame:
    from noesis.plans.retrieval import shown

    return shown(t, ranking.top(knn(t), 15), detail="brief", most=4).drop("timestamp")


@catalog("r20_access_events", f"WITH {_KNN} SELECT n.id, coalesce(access_count, 0) + count(k.v) AS access_count FROM nodes n LEFT JOIN knn k ON k.v = n.id GROUP BY n.id, access_count")
def r20(t: Store) -> DataFrame:
    """Access events of a result added up on the notes."""
    from noesis.operators.edits import touched
    from noesis.plans.retrieval import accesses

    return touched(t("nodes", "id", "access_count", "last_accessed"), accesses(knn(t), NOW)).select("id", F.col("access_count").cast("long").alias("access_count"))


# indexes


@catalog("x01_index_search", f"WITH {_KNN} SELECT q AS query_id, v AS node_id, round(s, 4) AS score FROM knn")
def x01(t: Store) -> DataFrame:
    """The nearest notes from a stored index; all cells are asked here, so the result is that of the scan."""
    path = os.path.join(shared_dir(t.spark), f"noesis-index-{uuid.uuid4().hex}")
    vector_index.build(t("nodes", "id", "embedding"), path)
    q = t("nodes", "id", "category", "embedding").filter("category = 'breakthrough'").select(F.col("id").alias("query_id"), "embedding")
    return vector_index.search(t.spark, path, q, k=15, probe=1 << 20).withColumn("score", F.round("score", 4))


@catalog("x05_to_repair", "SELECT id FROM nodes WHERE embedding IS NULL OR len(embedding) <> 128")
def x05(t: Store) -> DataFrame:
    from noesis.operators.lifecycle import missing

    return missing(t("nodes", "id", "embedding"), "vectors").select("id")


_SPARSE = "SELECT {key} AS doc, term AS token, count(*)::DOUBLE / any_value(n) AS w FROM (SELECT {key}, len(t) AS n, unnest(t) AS term FROM (SELECT {key}, regexp_extract_all(lower(text), '[a-zA-Zа-яА-ЯёЁ0-9_]+') AS t FROM {table})) GROUP BY 1, 2 HAVING count(*)::DOUBLE / any_value(n) > 0.02"


@catalog(
    "x10_sparse_search",
    f"""WITH d AS ({_SPARSE.format(key='doc_id', table='documents')}), e AS ({_SPARSE.format(key='item_id', table='eval_items')}), s AS (SELECT e.doc AS query, d.doc, sum(d.w * e.w) AS s FROM e JOIN d USING (token) GROUP BY 1, 2),
    n AS (SELECT query, doc, s / max(s) OVER (PARTITION BY query) AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS place FROM n) SELECT query, doc, round(score, 4) AS score, place::INTEGER AS place FROM r WHERE place <= 5""",
)
def x10(t: Store) -> DataFrame:
    """Inner products of sparse vectors, here of the shares of words."""
    from noesis.functions.text import tokens

    def sparse(table: str, key: str) -> DataFrame:
        words = t(table, key, "text").select(key, tokens("text").alias("t")).filter(F.size("t") > 0)
        c = words.select(key, F.size("t").alias("n"), F.explode("t").alias("term")).groupBy(key, "term").agg((F.count(F.lit(1)) / F.first("n")).alias("w"))
        return c.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("weights"))

    index = vector_index.sparse_index(sparse("documents", "doc_id"), "doc_id", "weights", least=0.02)
    found = vector_index.sparse_search(index, sparse("eval_items", "item_id"), "item_id", "weights", k=5, least=0.02)
    return found.select("query", "doc", F.round("score", 4).alias("score"), "place")


_BARE = ", ".join(f"b{k + 1} AS (SELECT q, v, sum(a) AS a FROM (SELECT q, v, a FROM b{k} UNION ALL SELECT q, dst, a * w * 0.7 FROM b{k} JOIN adj ON src = v WHERE a >= 0.01) GROUP BY 1, 2)" for k in range(2))


@catalog("x14_baseline_spreading", f"WITH {_ADJ}, {_SEEDS}, b0 AS (SELECT q, v, a FROM act0), {_BARE} SELECT q AS query_id, v AS node_id, round(a, 4) AS score FROM b2")
def x14(t: Store) -> DataFrame:
    return vector_index.baseline_spread(t("edges", *EDGE), seeds(t), rounds=2).withColumn("score", ranking.rounded("score"))


def _rank(t: Store) -> DataFrame:
    return graph.pagerank(t("edges", *EDGE), rounds=5, tolerance=0.0)


_RANK = f"{_PR}, pr AS (SELECT id, r / (SELECT max(r) FROM r5) AS rank FROM r5)"


@catalog("x15_rank_factor", f"WITH {_RANK} SELECT n.id, round(1 + 0.1 * coalesce(rank, 0), 6) AS factor FROM nodes n LEFT JOIN pr USING (id)")
def x15(t: Store) -> DataFrame:
    return t("nodes", "id").join(_rank(t).withColumnRenamed("node_id", "id"), "id", "left").select("id", F.round(ranking.rank_factor(F.col("rank")), 6).alias("factor"))


@catalog("t07_top_rank", f"WITH {_RANK} SELECT id AS node_id, round(rank, 6) AS rank FROM pr ORDER BY round(rank, 9) DESC, id LIMIT 10")
def t07(t: Store) -> DataFrame:
    return _rank(t).orderBy(F.desc(F.round("rank", 9)), "node_id").limit(10).select("node_id", F.round("rank", 6).alias("rank"))


@catalog(
    "j21_metrics_lookup",
    f"WITH {_RANK}, {_ADJ}, {graphs._LP} SELECT n.id, round(coalesce(rank, 0), 6) AS rank, coalesce(label, -1) AS community FROM nodes n LEFT JOIN pr USING (id) LEFT JOIN lab2 USING (id)",
)
def j21(t: Store) -> DataFrame:
    """Rank and community of every note, as the export feed shows them."""
    rank, community = _rank(t).withColumnRenamed("node_id", "id"), graph.communities(t("edges", *EDGE), rounds=2).withColumnRenamed("node_id", "id")
    return t("nodes", "id").join(rank, "id", "left").join(community, "id", "left").select("id", F.round(F.coalesce("rank", F.lit(0.0)), 6).alias("rank"), F.coalesce("community", F.lit(-1)).alias("community"))


@catalog("u02_members", "WITH m AS (SELECT source_id AS head, target_id AS id FROM edges WHERE edge_type = 'consolidation' UNION SELECT target_id, source_id FROM edges WHERE edge_type = 'consolidation'), r AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY id) AS r FROM m) SELECT head, id FROM r WHERE r <= 50")
def u02(t: Store) -> DataFrame:
    """Members at either end of a link, each once, the first fifty by id."""
    from noesis.operators.joins import adjacency

    m = adjacency(t("edges", *EDGE).filter("edge_type = 'consolidation'")).select(F.col("src").alias("head"), F.col("dst").alias("id")).distinct()
    return m.withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("id"))).filter("r <= 50").select("head", "id")


# measures

_X07 = f"found AS ({graphs.SQL['x07_bm25']})"


@catalog(
    "a15_recall_and_rank",
    f"""WITH {_X07}, h AS (SELECT item_id, min(place) AS rank FROM found f JOIN documents d ON d.doc_id = f.doc JOIN eval_items e ON e.item_id = f.query WHERE contains(lower(d.text), lower(substring(e.text, 1, 50))) GROUP BY 1),
    j AS (SELECT e.item_id, lang, coalesce(rank <= 5, false)::INT AS hit, coalesce(1.0 / rank, 0) AS rr FROM eval_items e LEFT JOIN h USING (item_id))
    SELECT CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END AS lang, grouping(lang)::INTEGER AS level, count(*) AS queries, sum(hit)::BIGINT AS hits, round(avg(hit), 4) AS recall, round(avg(rr), 4) AS mrr FROM j GROUP BY ROLLUP (lang)""",
)
def a15(t: Store) -> DataFrame:
    """Recall at five and mean reciprocal rank of the word index for passages, per language and over all."""
    found = graphs.x07(t).select(F.col("query").alias("query_id"), F.col("doc").alias("node_id"), "place")
    items = t("eval_items", F.col("item_id").alias("query_id"), "text", "lang")
    judged = evaluation.passage_hits(found, t("documents", F.col("doc_id").alias("id"), F.col("text").alias("content")), items).join(items.select("query_id", "lang"), "query_id")
    return evaluation.recall_and_rank(judged, "lang").withColumns({"recall": F.round("recall", 4), "mrr": F.round("mrr", 4)})


_PLAIN = r"trim(regexp_replace(regexp_replace(lower({c}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g'))"


@catalog(
    "a16_answer_scores",
    f"""WITH p AS (SELECT s.id, coalesce({_PLAIN.format(c='top_terms')}, '') AS a, coalesce({_PLAIN.format(c='content')}, '') AS b FROM cluster_summaries s JOIN nodes n ON n.id = representative_node_id),
    x AS (SELECT id, w, sum(s) AS x, sum(1 - s) AS y FROM (SELECT id, 1 AS s, unnest(string_split(a, ' ')) AS w FROM p UNION ALL SELECT id, 0, unnest(string_split(b, ' ')) FROM p) WHERE w <> '' GROUP BY 1, 2),
    m AS (SELECT id, sum(least(x, y)) AS k, sum(x) AS na, sum(y) AS nb FROM x GROUP BY 1)
    SELECT p.id, round(CASE WHEN k > 0 THEN 2 * (k / na) * (k / nb) / (k / na + k / nb) ELSE 0.0 END, 4) AS f1, round(CASE WHEN nb > 0 THEN k / nb ELSE 0.0 END, 4) AS rouge1, (a = b)::INTEGER AS exact FROM p LEFT JOIN m USING (id)""",
)
def a16(t: Store) -> DataFrame:
    """Word scores of a cluster's terms against its note."""
    pairs = t("cluster_summaries", "id", "top_terms", "representative_node_id").join(t("nodes", F.col("id").alias("representative_node_id"), "content"), "representative_node_id")
    return evaluation.answer_scores(pairs, "id", "top_terms", "content").select("id", F.round("f1", 4).alias("f1"), F.round("rouge1", 4).alias("rouge1"), "exact")


_EXPECTED = "expected AS (SELECT e.item_id AS q, d.doc_id AS v, e.item_id % 10 = 0 AS critical FROM eval_items e JOIN documents d ON contains(lower(d.text), lower(substring(e.text, 1, 50))))"


@catalog("a17_regression", f"WITH {_X07}, {_EXPECTED}, r AS (SELECT x.*, f.doc IS NOT NULL AS seen FROM expected x LEFT JOIN found f ON f.query = q AND f.doc = v) SELECT count(*) FILTER (seen) AS hits, count(*) AS expected, round(count(*) FILTER (seen) / count(*), 4) AS precision, count(*) FILTER (NOT seen AND critical) AS critical_misses FROM r")
def a17(t: Store) -> DataFrame:
    """How many of the documents that begin a passage are among its five best; few passages against all documents."""
    found = graphs.x07(t).select(F.col("query").alias("query_id"), F.col("doc").alias("node_id"), "place")
    items = t("eval_items", "item_id", F.lower(F.substring("text", 1, 50)).alias("e"))
    docs = t("documents", "doc_id", F.lower("text").alias("c"))
    expected = docs.join(F.broadcast(items), F.contains("c", "e")).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("node_id"), (F.col("item_id") % 10 == 0).alias("critical"))
    return evaluation.regression(found, expected).select("hits", "expected", F.round("precision", 4).alias("precision"), "critical_misses")


@catalog(
    "a18_keyword_hits",
    f"""WITH {_X07}, k AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-zA-ZЀ-ӿ]{{9,}}')) AS w FROM eval_items)
    SELECT item_id AS query_id, coalesce(bool_or(len([x FOR x IN w IF contains(lower(d.text), x)]) > 0), false) AS hit FROM k LEFT JOIN found f ON f.query = item_id LEFT JOIN documents d ON d.doc_id = f.doc GROUP BY 1""",
)
def a18(t: Store) -> DataFrame:
    from noesis.functions.text import topic_words

    found = graphs.x07(t).select(F.col("query").alias("query_id"), F.col("doc").alias("node_id"), "place")
    keys = t("eval_items", F.col("item_id").alias("query_id"), F.array_distinct(topic_words("text", 9)).alias("keywords"))
    return evaluation.keyword_hits(found, t("documents", F.col("doc_id").alias("id"), F.col("text").alias("content")), keys)


_SETTINGS = [(1, 1.0, 0.0, 0.0), (2, 0.6, 0.4, 0.0), (3, 0.3, 0.4, 0.3), (4, -1.0, 0.5, 0.5)]


@catalog(
    "a27_sweep",
    f"""WITH {_KNN}, x AS (SELECT q, v, s AS semantic, 1.0 / (60 + row_number() OVER (PARTITION BY q ORDER BY v)) AS spread, s * s AS words FROM knn), c(setting, alpha, beta, gamma) AS (VALUES {', '.join(map(str, _SETTINGS))}),
    w AS (SELECT DISTINCT source_id AS q, target_id AS v FROM edges WHERE source_id IN (SELECT q FROM knn)), p AS (SELECT setting, q, v, row_number() OVER (PARTITION BY setting, q ORDER BY round(semantic * alpha + spread * beta + words * gamma, 9) DESC, v) AS r FROM x CROSS JOIN c),
    b AS (SELECT setting, q, min(r) AS r FROM p JOIN w USING (q, v) GROUP BY 1, 2), e AS (SELECT setting, q FROM c CROSS JOIN (SELECT DISTINCT q FROM w))
    SELECT setting, count(*) AS queries, round(avg(coalesce((r <= 5)::INT, 0)), 4) AS recall, round(avg(coalesce(1.0 / r, 0)), 4) AS mrr FROM e LEFT JOIN b USING (setting, q) GROUP BY 1""",
)
def a27(t: Store) -> DataFrame:
    """Recall of linked notes under four blends of signals computed once."""
    from noesis.session import cut

    n = knn(t)
    w = Window.partitionBy("query_id").orderBy("node_id")
    x = cut(n.select("query_id", "node_id", F.col("score").alias("semantic"), (1.0 / (60 + F.row_number().over(w))).alias("spread"), (F.col("score") * F.col("score")).alias("words")), "signals")
    settings = t.spark.createDataFrame(_SETTINGS, "setting int, alpha double, beta double, gamma double")
    wanted = t("edges", "source_id", "target_id").select(F.col("source_id").alias("query_id"), F.col("target_id").alias("node_id")).join(x.select("query_id").distinct(), "query_id", "left_semi").distinct()
    return evaluation.sweep(x, settings, wanted).select("setting", "queries", F.round("recall", 4).alias("recall"), F.round("mrr", 4).alias("mrr"))


# signals


@catalog(
    "g11_hub_reach",
    f"""WITH hubs AS (SELECT source_id FROM edges GROUP BY 1 ORDER BY count(*) DESC, source_id LIMIT 5), near AS (SELECT * FROM (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY target_id) AS r FROM edges WHERE source_id IN (SELECT source_id FROM hubs)) WHERE r <= 2000),
    far AS (SELECT * FROM (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY target_id) AS r FROM edges WHERE source_id IN (SELECT target_id FROM near WHERE r <= 100)) WHERE r <= 200),
    x AS (SELECT count(*) AS reached FROM (SELECT source_id AS id FROM hubs UNION SELECT target_id FROM near UNION SELECT target_id FROM far)), c AS (SELECT count(*) AS total FROM nodes WHERE category NOT IN ({_list(V.NOT_COUNTED)}))
    SELECT reached, total, round(least(1.0, reached / total), 6) AS reach FROM x, c""",
)
def g11(t: Store) -> DataFrame:
    return signals.hub_reach(t("edges", *EDGE), t("nodes", "id", "category")).withColumn("reach", F.round("reach", 6))


@catalog(
    "a24_reflection",
    f"""SELECT by_category, by_word, total, round(least(1.0, greatest(by_category, by_word) / total), 6) AS reflection FROM (SELECT count(*) FILTER (category IN ({_list(V.RECALL_META)})) AS by_category,
    count(*) FILTER ({' OR '.join(f"content ILIKE '%{w}%'" if w.isascii() else f"contains(content, '{w}')" for w in V.META_WORDS)}) AS by_word, count(*) FILTER (category NOT IN ({_list(V.NOT_COUNTED)})) AS total FROM nodes)""",
)
def a24(t: Store) -> DataFrame:
    return signals.reflection(t("nodes", "id", "category", "content")).withColumn("reflection", F.round("reflection", 6))


_OUT = "l AS (SELECT source_id AS src, target_id AS dst, weight AS w FROM edges), c0 AS (SELECT id AS q, id AS v, 1.0::DOUBLE AS a FROM nodes ORDER BY id LIMIT 5)"
_CONV = ", ".join(
    f"""t{k} AS (SELECT q, v, sum(s) AS s FROM (SELECT q, v, a * 0.5 AS s FROM c{k} WHERE a >= 0.01 UNION ALL SELECT q, dst, a * w * 0.7 FROM c{k} JOIN l ON src = v WHERE a >= 0.01) GROUP BY 1, 2),
    c{k + 1} AS (SELECT q, v, CASE WHEN max(s) OVER (PARTITION BY q) > 0 THEN s / max(s) OVER (PARTITION BY q) ELSE s END AS a FROM t{k})"""
    for k in range(3)
)


@catalog("g14_convergence", f"WITH {_OUT}, {_CONV}, p AS (SELECT q, max(a) AS m, sum(a) AS t FROM c3 GROUP BY 1) SELECT count(*) AS seeds, round(avg(CASE WHEN t > 0 THEN m / t ELSE 0 END), 4) AS convergence FROM p")
def g14(t: Store) -> DataFrame:
    start = t("nodes", "id").orderBy("id").limit(5)
    return signals.convergence(t("edges", *EDGE), t("nodes", "id"), start=start).withColumn("convergence", F.round("convergence", 4))


@catalog(
    "a21_self_reference",
    f"""WITH u AS ({graphs._UNIT}), r AS (SELECT a.id AS q, b.category, row_number() OVER (PARTITION BY a.id ORDER BY array_inner_product(a.v, b.v) DESC, b.id) AS r FROM u a JOIN u b ON a.category = 'breakthrough' AND b.category NOT IN ({_list(V.NOT_COUNTED)})),
    p AS (SELECT q, sum((category IN ({_list(V.SELF_REFERENCE)}))::INT) / 5 AS p FROM r WHERE r <= 5 GROUP BY 1) SELECT count(*) AS queries, round(avg(p), 4) AS precision FROM p""",
)
def a21(t: Store) -> DataFrame:
    notes = t("nodes", "id", "category", "embedding")
    from noesis.functions.vectors import usable

    asked = notes.filter("category = 'breakthrough'").filter(usable("embedding", 128)).select(F.col("id").alias("query_id"), "embedding")
    return signals.self_precision(asked, notes).withColumn("precision", F.round("precision", 4))


@catalog("m14_emergence")
def m14(t: Store) -> DataFrame:
    """The emergence signals with the notes of one category as queries about the store itself."""
    from noesis.plans.upkeep import emergence_row

    asked = t("nodes", "id", "category", "embedding").filter("category = 'self-reflection'").select(F.col("id").alias("query_id"), "embedding")
    return emergence_row(t, asked)


@catalog("g09_largest_part")
def g09l(t: Store) -> DataFrame:
    """Communities of the largest connected part, numbered by size; other notes have -1."""
    return graph.largest_communities(t("edges", *EDGE))


# logs

_LOG = "log AS (SELECT event_type AS query, ts AS timestamp, (user_id % 4)::INTEGER AS results_count, value / 100 AS top1_score, value AS latency_total_ms, value / 2 AS latency_embedding_ms, value / 4 AS latency_ann_ms FROM events)"


def _log(t: Store) -> DataFrame:
    """Events read as a search log."""
    e = t("events", "event_type", "ts", "user_id", "value")
    return e.select(
        F.col("event_type").alias("query"), F.col("ts").alias("timestamp"), (F.col("user_id") % 4).cast("int").alias("results_count"), (F.col("value") / 100).alias("top1_score"), F.col("value").alias("latency_total_ms"),
        (F.col("value") / 2).alias("latency_embedding_ms"), (F.col("value") / 4).alias("latency_ann_ms"), *[F.lit(0.0).alias(f"latency_{p}_ms") for p in searchlog.PHASES[2:]],
    )


@catalog(
    "a11_search_statistics",
    f"""WITH {_LOG}, d AS (SELECT * FROM log WHERE timestamp::DATE = DATE '2024-01-05'), r AS (SELECT latency_total_ms AS x, row_number() OVER (ORDER BY latency_total_ms) - 1 AS i, count(*) OVER () AS n FROM d WHERE latency_total_ms IS NOT NULL),
    p AS (SELECT max(CASE WHEN i = n // 2 THEN x END) AS p50, max(CASE WHEN i = floor(n * 0.95) THEN x END) AS p95, max(CASE WHEN i = floor(n * 0.99) THEN x END) AS p99, max(x) AS most FROM r)
    SELECT count(*) AS searches, count(*) FILTER (results_count = 0) AS zero_results, round(avg(top1_score) FILTER (results_count > 0), 3) AS mean_top1, round(avg(latency_embedding_ms), 1) AS mean_embedding_ms, any_value(p50) AS p50, any_value(p95) AS p95, any_value(p99) AS p99, any_value(most) AS most,
    (SELECT count(*) FROM log) AS searches_ever FROM d, p""",
)
def a11(t: Store) -> DataFrame:
    s = searchlog.statistics(_log(t), day="2024-01-05")
    return s.select("searches", "zero_results", F.round("mean_top1", 3).alias("mean_top1"), "mean_embedding_ms", "p50", "p95", "p99", "most", "searches_ever")


@catalog("a12_recent_zero_results", f"WITH {_LOG} SELECT query, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at FROM log WHERE results_count = 0 ORDER BY timestamp DESC, query LIMIT 10")
def a12z(t: Store) -> DataFrame:
    return searchlog.zero_results(_log(t)).select("query", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


_DAILY = "daily AS (SELECT ts::DATE AS day, avg(value) AS v FROM events GROUP BY 1)"


def _daily(t: Store) -> DataFrame:
    return t("events", "ts", "value").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))


@catalog("w07_change", f"WITH {_DAILY} SELECT strftime(day, '%Y-%m-%d') AS day, round(v, 4) AS v, round(v - lag(v) OVER (ORDER BY day), 4) AS change FROM daily")
def w07(t: Store) -> DataFrame:
    return signals.with_change(_daily(t), "v", "day").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("v", 4).alias("v"), F.round("change", 4).alias("change"))


@catalog("a19_trend", f"WITH {_DAILY} SELECT count(*) AS runs, round(arg_min(v, day), 4) AS first, round(arg_max(v, day), 4) AS latest, round(min(v), 4) AS least, round(max(v), 4) AS most, round(avg(v), 4) AS mean FROM daily")
def a19(t: Store) -> DataFrame:
    s = signals.trend(_daily(t), "v", "day")
    return s.select("runs", *[F.round(c, 4).alias(c) for c in s.columns if c != "runs"])


@catalog("a26_latest", f"WITH {_DAILY} SELECT strftime(day, '%Y-%m-%d') AS day, round(v, 4) AS v FROM daily ORDER BY daily.day DESC LIMIT 3")
def a26(t: Store) -> DataFrame:
    return signals.latest(_daily(t), 3, "day").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("v", 4).alias("v"))


@catalog("a25_weakest_month", "WITH m AS (SELECT strftime(created_at, '%Y-%m') AS month, count(*) FILTER (edge_type = 'semantic') AS semantic, count(*) FILTER (edge_type = 'entity') AS entity FROM edges WHERE created_at IS NOT NULL GROUP BY 1) SELECT month, round(0.3 * semantic + 0.7 * entity, 4) AS composite, CASE WHEN semantic <= entity THEN 'semantic' ELSE 'entity' END AS weakest FROM m")
def a25(t: Store) -> DataFrame:
    """A weighted sum and the weakest part, as the signals have them, on counts of edges."""
    m = t("edges", "created_at", "edge_type").filter("created_at is not null").groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count_if(F.col("edge_type") == "semantic").alias("semantic"), F.count_if(F.col("edge_type") == "entity").alias("entity"))
    weakest = F.array_min(F.array(F.struct(F.col("semantic").alias("v"), F.lit(0).alias("k"), F.lit("semantic").alias("n")), F.struct(F.col("entity").alias("v"), F.lit(1).alias("k"), F.lit("entity").alias("n"))))["n"]
    return m.select("month", F.round(0.3 * F.col("semantic") + 0.7 * F.col("entity"), 4).alias("composite"), weakest.alias("weakest"))


@catalog(
    "a13_snapshots",
    """WITH n AS (SELECT strftime(timestamp, '%Y-%m') AS month, count(*) AS notes, count(*) FILTER (importance = 'critical') AS critical, round(avg(emotional_intensity), 4) AS intensity, count(DISTINCT category) AS categories FROM nodes WHERE timestamp IS NOT NULL GROUP BY 1),
    d AS (SELECT strftime(timestamp, '%Y-%m') AS month, count(e.source_id) AS ends FROM nodes LEFT JOIN edges e ON e.source_id = id WHERE timestamp IS NOT NULL GROUP BY 1),
    t AS (SELECT month, string_agg(category, ',' ORDER BY c DESC, category) AS top FROM (SELECT month, category, c, row_number() OVER (PARTITION BY month ORDER BY c DESC, category) AS r FROM (SELECT strftime(timestamp, '%Y-%m') AS month, category, count(*) AS c FROM nodes WHERE timestamp IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2)) WHERE r <= 8 GROUP BY 1)
    SELECT month, notes, critical, intensity, categories, round(ends / notes, 4) AS mean_degree, top FROM n JOIN d USING (month) LEFT JOIN t USING (month)""",
)
def a13(t: Store) -> DataFrame:
    """What a store looked like by month of its notes: counts, mean out-degree, importance, mean intensity, eight top categories."""
    n = t("nodes", "id", "timestamp", "category", "importance", "emotional_intensity").filter("timestamp is not null").withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    out = t("edges", "source_id").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    per = n.join(out, "id", "left").groupBy("month").agg(
        F.count(F.lit(1)).alias("notes"), F.count_if(F.col("importance") == "critical").alias("critical"), F.round(F.avg("emotional_intensity"), 4).alias("intensity"), F.countDistinct("category").alias("categories"),
        F.round(F.sum(F.coalesce("d", F.lit(0))) / F.count(F.lit(1)), 4).alias("mean_degree"),
    )
    c = n.filter("category is not null").groupBy("month", "category").agg(F.count(F.lit(1)).alias("c"))
    eight = c.withColumn("r", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("c"), "category"))).filter("r <= 8")
    top = eight.groupBy("month").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "category"))), lambda x: x["category"]), ",").alias("top"))
    return per.join(top, "month", "left")
