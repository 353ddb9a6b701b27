"""Scans, predicates, joins, aggregates, windows and set operations over the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noesis import vocabulary as V
from noesis.functions import vectors
from noesis.operators import access, joins, searchlog
from noesis.plans.registry import Catalog, Store

catalog = Catalog()
QUERIES, SQL = catalog.QUERIES, catalog.SQL

CUTOFF = "2025-06-01 00:00:00"
_stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
_quoted = ", ".join(f"'{c}'" for c in V.PROTECTED)
_words = " OR ".join(f"contains(lower(category), '{w}')" for w in V.PROTECTED_WORDS)
_PROTECTED = f"""protected AS (SELECT DISTINCT lower(category) AS category FROM nodes WHERE category IS NOT NULL AND (lower(trim(importance)) = 'critical' OR {_words})
    UNION SELECT unnest([{_quoted}]))"""


@catalog("s01_nodes", "SELECT id, category, importance, access_count, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at FROM nodes")
def s01(t: Store) -> DataFrame:
    return t("nodes", "id", "category", "importance", "access_count", "timestamp").select("id", "category", "importance", "access_count", _stamp("timestamp").alias("at"))


@catalog("s02_edges", "SELECT source_id, target_id, weight, edge_type FROM edges")
def s02(t: Store) -> DataFrame:
    return t("edges", "source_id", "target_id", "weight", "edge_type")


@catalog("s03_point_lookup", "SELECT id, content, category FROM nodes WHERE id = (SELECT min(id) FROM nodes)")
def s03(t: Store) -> DataFrame:
    first = t("nodes", "id").agg(F.min("id")).first()[0]
    return access.point(t("nodes", "id", "content", "category"), first)


@catalog("s04_category_read", "SELECT id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at FROM nodes WHERE category = 'technical' ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 5")
def s04(t: Store) -> DataFrame:
    return access.read_category(t("nodes", "id", "category", "timestamp"), "technical", 5).select("id", _stamp("timestamp").alias("at"))


@catalog("s05_incremental", f"SELECT id FROM nodes WHERE timestamp > TIMESTAMP '{CUTOFF}'")
def s05(t: Store) -> DataFrame:
    return access.since(t("nodes", "id", "timestamp"), CUTOFF).select("id")


@catalog(
    "s06_graph_feed",
    """WITH d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1)
    SELECT n.id, category, substring(split_part(content, chr(10), 1), 1, 200) AS preview, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN d ON d.id = n.id""",
)
def s06(t: Store) -> DataFrame:
    ends = t("edges", "source_id", "target_id").select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return t("nodes", "id", "category", "content").join(ends, "id", "left").select("id", "category", access.first_line("content").alias("preview"), F.coalesce("degree", F.lit(0)).alias("degree"))


@catalog("s07_node_detail", "SELECT id, content, category, importance, emotional_tone, emotional_intensity, tags FROM nodes")
def s07(t: Store) -> DataFrame:
    return t.nodes.drop("embedding").select("id", "content", "category", "importance", "emotional_tone", "emotional_intensity", "tags")


@catalog("f02_time_range", f"SELECT id FROM nodes WHERE timestamp IS NULL OR timestamp BETWEEN TIMESTAMP '2025-01-01' AND TIMESTAMP '{CUTOFF}'")
def f02(t: Store) -> DataFrame:
    return access.in_time(t("nodes", "id", "timestamp"), "2025-01-01 00:00:00", CUTOFF).select("id")


@catalog("f03_entity_type", "SELECT id FROM nodes WHERE id IN (SELECT node_id FROM node_entities l JOIN entities e ON e.id = l.entity_id WHERE lower(trim(entity_type)) = 'tech')")
def f03(t: Store) -> DataFrame:
    return access.with_entity_type(t("nodes", "id"), t.node_entities, t.entities, "tech").select("id")


@catalog("f05_without_synthetic", f"SELECT id FROM nodes WHERE category IS NULL OR category NOT IN ({', '.join(repr(c) for c in V.SYNTHETIC)})")
def f05(t: Store) -> DataFrame:
    return t("nodes", "id", "category").filter(F.col("category").isNull() | ~F.col("category").isin(V.SYNTHETIC)).select("id")


@catalog("f08_protected_categories", f"WITH {_PROTECTED} SELECT category FROM protected")
def f08(t: Store) -> DataFrame:
    return access.protected_categories(t("nodes", "category", "importance"))


@catalog("f09_keyword_notes", "SELECT id FROM nodes WHERE content ILIKE '%review board%' OR content ILIKE '%memory graph%' OR content ILIKE '%граф памяти%'")
def f09(t: Store) -> DataFrame:
    c = F.col("content")
    return t("nodes", "id", "content").filter(c.ilike("%review board%") | c.ilike("%memory graph%") | c.ilike("%граф памяти%")).select("id")


@catalog(
    "f10_valid_entities",
    f"""SELECT id FROM entities WHERE length(trim(name)) >= 2 AND NOT regexp_matches(trim(name), '^[0-9]+$')
    AND lower(trim(name)) NOT IN ({', '.join(repr(w) for w in V.STOPWORDS)}) AND len(regexp_split_to_array(trim(name), '\\s+')) <= 4""",
)
def f10(t: Store) -> DataFrame:
    return t("entities", "id", "name").filter(access.valid_entity("name")).select("id")


@catalog("f11_long_notes", "SELECT id FROM nodes WHERE length(content) >= 80 AND (category IS NULL OR category NOT IN ('keyword-anchor', 'abstract-topic'))")
def f11(t: Store) -> DataFrame:
    return t("nodes", "id", "content", "category").filter((F.length("content") >= 80) & (F.col("category").isNull() | ~F.col("category").isin("keyword-anchor", "abstract-topic"))).select("id")


@catalog("f12_heavy_edges", "SELECT source_id, target_id, edge_type, weight FROM edges WHERE weight >= 0.8")
def f12(t: Store) -> DataFrame:
    return t("edges", "source_id", "target_id", "edge_type", "weight").filter("weight >= 0.8")


@catalog("f13_stale_edges", f"SELECT source_id, target_id, edge_type FROM edges WHERE created_at < TIMESTAMP '{CUTOFF}' AND weight > 0.3")
def f13(t: Store) -> DataFrame:
    return t.edges.filter(access.stale("created_at", "weight", CUTOFF)).select("source_id", "target_id", "edge_type")


@catalog(
    "f14_briefs",
    """SELECT id, CASE WHEN length(split_part(content, chr(10), 1)) > 150 THEN substring(split_part(content, chr(10), 1), 1, 147) || '...' ELSE split_part(content, chr(10), 1) END AS brief FROM nodes""",
)
def f14(t: Store) -> DataFrame:
    return t("nodes", "id", "content").select("id", access.brief("content").alias("brief"))


@catalog(
    "j01_neighbours",
    """WITH q AS (SELECT id FROM nodes WHERE category = 'breakthrough'), a AS (SELECT source_id AS src, target_id AS dst, weight, edge_type FROM edges UNION ALL SELECT target_id, source_id, weight, edge_type FROM edges)
    SELECT DISTINCT src, dst, weight, edge_type FROM a WHERE src IN (SELECT id FROM q)""",
)
def j01(t: Store) -> DataFrame:
    return joins.neighbours(t("edges", "source_id", "target_id", "weight", "edge_type"), t("nodes", "id", "category").filter("category = 'breakthrough'"))


@catalog("j02_notes_of_entities", "SELECT DISTINCT e.id AS entity_id, n.id AS node_id, n.category FROM entities e JOIN node_entities l ON l.entity_id = e.id JOIN nodes n ON n.id = l.node_id")
def j02(t: Store) -> DataFrame:
    links = t("node_entities", "node_id", "entity_id").distinct()
    return links.join(t("entities", F.col("id").alias("entity_id")), "entity_id").join(t("nodes", F.col("id").alias("node_id"), "category"), "node_id").select("entity_id", "node_id", "category")


_ONCE = "l AS (SELECT DISTINCT node_id, entity_id FROM node_entities), few AS (SELECT entity_id FROM l GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), k AS (SELECT * FROM l WHERE entity_id IN (SELECT entity_id FROM few))"


@catalog("j03_co_mentions", f"WITH {_ONCE} SELECT a.node_id AS node_a, b.node_id AS node_b, count(*) AS shared FROM k a JOIN k b USING (entity_id) WHERE a.node_id < b.node_id GROUP BY 1, 2")
def j03(t: Store) -> DataFrame:
    return joins.co_mentions(t.node_entities)


@catalog("j03_hub_entities", "SELECT entity_id, count(DISTINCT node_id) AS notes FROM node_entities GROUP BY 1 HAVING count(DISTINCT node_id) > 50")
def j03_hubs(t: Store) -> DataFrame:
    return joins.hub_entities(t.node_entities)


@catalog("j03_hub_members", "SELECT DISTINCT entity_id, node_id FROM node_entities WHERE entity_id IN (SELECT entity_id FROM node_entities GROUP BY 1 HAVING count(DISTINCT node_id) > 50)")
def j03_members(t: Store) -> DataFrame:
    return joins.hub_members(t.node_entities)


@catalog(
    "j10_resonance",
    """WITH w AS (SELECT id, list_distinct([trim(lower(x)) FOR x IN string_split(emotional_tone, ',') IF trim(x) <> '']) AS tags FROM nodes WHERE emotional_tone IS NOT NULL),
    s AS (SELECT p.id AS a, q.id AS b, len(list_intersect(p.tags, q.tags)) AS k, len(p.tags) + len(q.tags) AS n FROM w p JOIN w q ON p.id <> q.id WHERE len(p.tags) >= 2 AND len(q.tags) >= 2),
    r AS (SELECT a, b, k::DOUBLE / (n - k) AS weight, row_number() OVER (PARTITION BY a ORDER BY k::DOUBLE / (n - k) DESC, b DESC) AS r FROM s WHERE k >= 2)
    SELECT DISTINCT least(a, b) AS node_a, greatest(a, b) AS node_b, round(weight, 6) AS weight FROM r WHERE r <= 5""",
)
def j10(t: Store) -> DataFrame:
    tones = F.filter(F.transform(F.split("emotional_tone", ","), lambda x: F.trim(F.lower(x))), lambda x: x != "")
    notes = t("nodes", "id", "emotional_tone").filter("emotional_tone is not null")
    return joins.tag_resonance(notes, tones).withColumn("weight", F.round("weight", 6))


@catalog("j13_orphans", "WITH d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1) SELECT n.id, category, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN d USING (id) WHERE coalesce(degree, 0) <= 1")
def j13(t: Store) -> DataFrame:
    return joins.orphan_notes(t("nodes", "id", "category"), t("edges", "source_id", "target_id"))


@catalog(
    "j14_protected_edges",
    f"""WITH {_PROTECTED}, p AS (SELECT id FROM nodes WHERE lower(category) IN (SELECT category FROM protected))
    SELECT source_id, target_id, edge_type FROM edges WHERE source_id IN (SELECT id FROM p) OR target_id IN (SELECT id FROM p)""",
)
def j14(t: Store) -> DataFrame:
    safe = access.protected_categories(t("nodes", "category", "importance"))
    ids = t("nodes", "id", "category").withColumn("category", F.lower("category")).join(safe, "category", "left_semi").select("id", F.lit(True).alias("safe"))
    e = t("edges", "source_id", "target_id", "edge_type")
    for side in ("source_id", "target_id"):
        e = e.join(ids.select(F.col("id").alias(side), F.col("safe").alias(f"safe_{side}")), side, "left")
    return e.filter(F.coalesce("safe_source_id", "safe_target_id")).select("source_id", "target_id", "edge_type")


@catalog("j15_unused_entities", "SELECT id FROM entities WHERE id NOT IN (SELECT entity_id FROM node_entities WHERE entity_id IS NOT NULL)")
def j15(t: Store) -> DataFrame:
    return joins.without_any(t("entities", "id"), t("node_entities", F.col("entity_id").alias("id")).distinct(), ["id"])


@catalog("j16_parents", "SELECT source_id AS id, min(target_id) AS parent FROM edges WHERE edge_type = 'PART_OF' GROUP BY 1")
def j16(t: Store) -> DataFrame:
    return t("edges", "source_id", "target_id", "edge_type").filter("edge_type = 'PART_OF'").groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("parent"))


@catalog("j17_siblings", "SELECT target_id AS parent, count(DISTINCT source_id) AS parts FROM edges WHERE edge_type = 'PART_OF' GROUP BY 1 HAVING count(DISTINCT source_id) > 1")
def j17(t: Store) -> DataFrame:
    return t("edges", "source_id", "target_id", "edge_type").filter("edge_type = 'PART_OF'").groupBy(F.col("target_id").alias("parent")).agg(F.countDistinct("source_id").alias("parts")).filter("parts > 1")


@catalog("a01_by_category", "SELECT category, count(*) AS notes FROM nodes GROUP BY 1")
def a01(t: Store) -> DataFrame:
    return t("nodes", "category").groupBy("category").agg(F.count(F.lit(1)).alias("notes"))


@catalog("a01_by_edge_type", "SELECT edge_type, count(*) AS edges, round(sum(weight), 4) AS weight FROM edges GROUP BY 1")
def a01e(t: Store) -> DataFrame:
    return t("edges", "edge_type", "weight").groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 4).alias("weight"))


@catalog("a01_totals", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM entities) AS entities")
def a01t(t: Store) -> DataFrame:
    one = lambda name, c: t(name, c).agg(F.count(F.lit(1)).alias(name))
    return one("nodes", "id").crossJoin(one("edges", "source_id")).crossJoin(one("entities", "id"))


@catalog("a02_entities_per_note", "SELECT node_id, count(DISTINCT entity_id) AS entities FROM node_entities GROUP BY 1")
def a02(t: Store) -> DataFrame:
    return t.node_entities.select("node_id", "entity_id").distinct().groupBy("node_id").agg(F.count("entity_id").alias("entities"))


@catalog("a03_merge_candidates", "SELECT lower(trim(name)) AS name, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS ids FROM entities WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def a03(t: Store) -> DataFrame:
    return joins.merge_candidates(t.entities).withColumn("ids", F.array_join("ids", ","))


@catalog("a05_distinct_counts", "SELECT (SELECT count(DISTINCT lower(trim(entity_type))) FROM entities) AS entity_types, (SELECT count(DISTINCT category) FROM nodes) AS categories, (SELECT count(DISTINCT edge_type) FROM edges) AS edge_types")
def a05(t: Store) -> DataFrame:
    return (
        t("entities", "entity_type").agg(F.countDistinct(F.lower(F.trim("entity_type"))).alias("entity_types"))
        .crossJoin(t("nodes", "category").agg(F.countDistinct("category").alias("categories")))
        .crossJoin(t("edges", "edge_type").agg(F.countDistinct("edge_type").alias("edge_types")))
    )


@catalog(
    "a09_intensity_degree",
    """WITH d AS (SELECT source_id AS id, count(*) AS degree FROM edges GROUP BY 1)
    SELECT round(abs(corr(emotional_intensity::DOUBLE, coalesce(degree, 0)::DOUBLE)), 6) AS correlation FROM nodes LEFT JOIN d USING (id) WHERE emotional_intensity IS NOT NULL""",
)
def a09(t: Store) -> DataFrame:
    degree = t("edges", "source_id").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    rows = t("nodes", "id", "emotional_intensity").filter("emotional_intensity is not null").join(degree, "id", "left")
    return rows.agg(F.round(F.abs(F.corr(F.col("emotional_intensity").cast("double"), F.coalesce("degree", F.lit(0)).cast("double"))), 6).alias("correlation"))


@catalog(
    "a10_percentiles",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(CASE WHEN i = n // 2 THEN value END) AS p50, max(CASE WHEN i = floor(n * 0.95) THEN value END) AS p95, max(CASE WHEN i = floor(n * 0.99) THEN value END) AS p99, max(value) AS most FROM r GROUP BY 1""",
)
def a10(t: Store) -> DataFrame:
    return searchlog.ranked_values(t("events", "event_type", "value"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@catalog("a12_zero_results", "SELECT event_type, count(*) AS n, sum((value = 0)::INT)::BIGINT AS zeros, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a12(t: Store) -> DataFrame:
    return t("events", "event_type", "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") == 0).cast("long")).alias("zeros"), F.round(F.avg("value"), 6).alias("mean"))


@catalog(
    "a13_evolution",
    """SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS edges, sum((edge_type = 'semantic')::INT)::BIGINT AS semantic, sum((edge_type = 'entity')::INT)::BIGINT AS entity,
    sum((edge_type = 'CONTRADICTS')::INT)::BIGINT AS "CONTRADICTS" FROM edges WHERE created_at IS NOT NULL GROUP BY 1""",
)
def a13(t: Store) -> DataFrame:
    kinds = ["semantic", "entity", "CONTRADICTS"]
    rows = t("edges", "created_at", "edge_type").filter("created_at is not null").withColumn("month", F.date_format("created_at", "yyyy-MM"))
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("edges"), *[F.sum((F.col("edge_type") == k).cast("long")).alias(k) for k in kinds])


@catalog(
    "a14_weight_distribution",
    """WITH r AS (SELECT edge_type, weight, row_number() OVER (PARTITION BY edge_type ORDER BY weight) - 1 AS i, count(*) OVER (PARTITION BY edge_type) AS n FROM edges)
    SELECT edge_type, min(weight) AS least, max(CASE WHEN i = n // 2 THEN weight END) AS median, max(weight) AS most, sum((weight < 0.5)::INT)::BIGINT AS below_50, sum((weight < 0.65)::INT)::BIGINT AS below_65 FROM r GROUP BY 1""",
)
def a14(t: Store) -> DataFrame:
    e = t("edges", "edge_type", "weight")
    # duplicates of a weight are counted first, so the ranked rows are distinct weights, not edges
    c = e.groupBy("edge_type", "weight").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("edge_type")
    c = c.withColumn("upto", F.sum("c").over(w.orderBy("weight"))).withColumn("n", F.sum("c").over(w))
    median = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("weight")))
    below = lambda x: F.sum(F.when(F.col("weight") < x, F.col("c")).otherwise(0))
    return c.groupBy("edge_type").agg(F.min("weight").alias("least"), median.alias("median"), F.max("weight").alias("most"), below(0.5).alias("below_50"), below(0.65).alias("below_65"))


@catalog("a20_adjacency_statistics", "WITH v AS (SELECT source_id AS id FROM edges UNION SELECT target_id FROM edges) SELECT (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM v) AS nodes, round(2.0 * (SELECT count(*) FROM edges) / (SELECT count(*) FROM v), 6) AS degree")
def a20(t: Store) -> DataFrame:
    e = t("edges", "source_id", "target_id")
    v = e.select(F.explode(F.array("source_id", "target_id")).alias("id")).agg(F.countDistinct("id").alias("nodes"))
    return e.agg(F.count(F.lit(1)).alias("edges")).crossJoin(v).withColumn("degree", F.round(2.0 * F.col("edges") / F.col("nodes"), 6))


@catalog(
    "a23_world_richness",
    """SELECT round((least(1.0, (SELECT count(DISTINCT lower(trim(entity_type))) FROM entities) / 10.0) + least(1.0, (SELECT count(DISTINCT category) FROM nodes) / 30.0)
    + least(1.0, (SELECT count(DISTINCT edge_type) FROM edges) / 15.0) + least(1.0, (SELECT count(*) FROM entities) / 3000.0)) / 4, 6) AS richness""",
)
def a23(t: Store) -> DataFrame:
    counts = a05(t).crossJoin(t("entities", "id").agg(F.count(F.lit(1)).alias("n")))
    part = lambda c, cap: F.least(F.lit(1.0), F.col(c) / F.lit(float(cap)))
    return counts.select(F.round((part("entity_types", 10) + part("categories", 30) + part("edge_types", 15) + part("n", 3000)) / 4, 6).alias("richness"))


@catalog(
    "a15_retrieval_rollup",
    """WITH r AS (SELECT category, importance, access_count FROM nodes)
    SELECT coalesce(category, '*') AS category, grouping(category) AS level, count(*) AS n, round(avg((access_count > 0)::INT), 6) AS hit_rate, round(avg(1.0 / (1 + access_count)), 6) AS mrr FROM r GROUP BY ROLLUP (category)""",
)
def a15(t: Store) -> DataFrame:
    n = t("nodes", "category", "access_count")
    agg = [F.grouping("category").cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("access_count") > 0).cast("int")), 6).alias("hit_rate"), F.round(F.avg(1.0 / (1 + F.col("access_count"))), 6).alias("mrr")]
    return n.rollup("category").agg(*agg).withColumn("category", F.coalesce("category", F.lit("*")))


@catalog(
    "w01_temporal_chains",
    """WITH o AS (SELECT category, id, timestamp, lag(timestamp) OVER w AS p FROM nodes WHERE timestamp IS NOT NULL AND category IS NOT NULL WINDOW w AS (PARTITION BY category ORDER BY timestamp, id)),
    f AS (SELECT *, (p IS NULL OR floor((epoch_us(timestamp) - epoch_us(p)) / 86400000000.0) > 7)::INT AS fresh FROM o),
    c AS (SELECT *, sum(fresh) OVER (PARTITION BY category ORDER BY timestamp, id) AS chain FROM f),
    s AS (SELECT *, count(*) OVER (PARTITION BY category, chain) AS size, lead(id) OVER (PARTITION BY category, chain ORDER BY timestamp, id) AS next FROM c)
    SELECT category, id AS source_id, next AS target_id FROM s WHERE size >= 3 AND next IS NOT NULL""",
)
def w01(t: Store) -> DataFrame:
    return temporal_chains(t("nodes", "id", "category", "timestamp"))


def temporal_chains(notes: DataFrame, *, most_days: int = 7, least: int = 3) -> DataFrame:
    """Consecutive notes of a category whose gaps are at most ``most_days`` whole days, in chains of ``least`` or more.

    Categories are few and one may hold a third of all notes, so the running window is cut by category and month: breaks
    are found from the previous note by time inside a month, and the first note of each month looks back through one row
    per (category, month)."""
    n = notes.filter("timestamp is not null and category is not null").withColumn("month", F.date_trunc("month", "timestamp"))
    order = ["timestamp", "id"]
    inside = Window.partitionBy("category", "month").orderBy(*order)
    edge = n.groupBy("category", "month").agg(F.max(F.struct("timestamp", "id")).alias("last"))
    carried = edge.withColumn("before", F.lag("last").over(Window.partitionBy("category").orderBy("month"))).select("category", "month", "before")
    n = n.withColumn("prev", F.lag("timestamp").over(inside)).join(carried, ["category", "month"])
    prev = F.coalesce("prev", F.col("before.timestamp"))
    gap = F.floor((F.unix_micros("timestamp") - F.unix_micros(prev)) / F.lit(86_400_000_000))
    n = n.withColumn("fresh", (prev.isNull() | (gap > most_days)).cast("int"))
    # chain number: breaks inside the month so far plus breaks of all months before
    months = n.groupBy("category", "month").agg(F.sum("fresh").alias("breaks"))
    upto = months.withColumn("base", F.coalesce(F.sum("breaks").over(Window.partitionBy("category").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = n.withColumn("run", F.sum("fresh").over(inside)).join(upto.select("category", "month", "base"), ["category", "month"]).withColumn("chain", F.col("run") + F.col("base"))
    sizes = n.groupBy("category", "chain").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    first = n.groupBy("category", "month").agg(F.min(F.struct("timestamp", "id", "chain")).alias("head"))
    following = first.withColumn("then", F.lead("head").over(Window.partitionBy("category").orderBy("month"))).select("category", "month", "then")
    n = n.withColumn("next", F.lead("id").over(inside)).withColumn("next_chain", F.lead("chain").over(inside)).join(following, ["category", "month"])
    target, chain = F.coalesce("next", F.col("then.id")), F.coalesce("next_chain", F.col("then.chain"))
    return n.filter(chain == F.col("chain")).join(sizes, ["category", "chain"]).select("category", F.col("id").alias("source_id"), target.alias("target_id"))


@catalog("w02_newest_three", "SELECT category, id FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY timestamp DESC NULLS LAST, id DESC) AS r FROM nodes) WHERE r <= 3")
def w02(t: Store) -> DataFrame:
    w = Window.partitionBy("category").orderBy(F.desc("timestamp"), F.desc("id"))
    return t("nodes", "id", "category", "timestamp").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("category", "id")


@catalog(
    "w05_temporal_position",
    """SELECT id, round(CASE WHEN b > a THEN (epoch_us(timestamp) - a) / (b - a)::DOUBLE ELSE 0.5 END, 6) AS place
    FROM nodes, (SELECT min(epoch_us(timestamp)) AS a, max(epoch_us(timestamp)) AS b FROM nodes) WHERE timestamp IS NOT NULL""",
)
def w05(t: Store) -> DataFrame:
    n = t("nodes", "id", "timestamp").filter("timestamp is not null").withColumn("t", F.unix_micros("timestamp"))
    ends = n.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    place = F.when(F.col("b") > F.col("a"), (F.col("t") - F.col("a")) / (F.col("b") - F.col("a")).cast("double")).otherwise(0.5)
    return n.crossJoin(F.broadcast(ends)).select("id", F.round(place, 6).alias("place"))


@catalog("w06_previous_entry", "SELECT id, lag(id) OVER (ORDER BY timestamp, id) AS previous FROM nodes WHERE category = 'working-memory' AND timestamp IS NOT NULL")
def w06(t: Store) -> DataFrame:
    n = t("nodes", "id", "category", "timestamp").filter("category = 'working-memory' and timestamp is not null").select("id", "timestamp")
    p = joins.positions(n, ["timestamp", "id"])
    return p.join(p.select((F.col("pos") + 1).alias("pos"), F.col("id").alias("previous")), "pos", "left").select("id", "previous")


@catalog("u01_degrees", "SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1")
def u01(t: Store) -> DataFrame:
    return t("edges", "source_id", "target_id").select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


@catalog("u04_intersection", "SELECT source_id AS id FROM edges INTERSECT SELECT node_id FROM node_entities")
def u04(t: Store) -> DataFrame:
    return t("edges", F.col("source_id").alias("id")).distinct().join(t("node_entities", F.col("node_id").alias("id")).distinct(), "id", "left_semi")


@catalog("t05_guarded_page", "SELECT id, length(content) // 4 AS tokens, (SELECT count(*) > 20 FROM nodes WHERE category = 'skill') AS has_more FROM nodes WHERE category = 'skill' ORDER BY id LIMIT 20")
def t05(t: Store) -> DataFrame:
    n = t("nodes", "id", "content", "category").filter("category = 'skill'")
    more = n.agg((F.count(F.lit(1)) > 20).alias("has_more"))
    return n.orderBy("id").limit(20).select("id", F.floor(F.length("content") / 4).alias("tokens")).crossJoin(F.broadcast(more))


@catalog("t06_hubs", "SELECT source_id AS id, count(*) AS degree FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def t06(t: Store) -> DataFrame:
    return t("edges", "source_id").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id").limit(5)


@catalog(
    "j11_nearest_in_time",
    """WITH n AS (SELECT id, epoch_us(timestamp) AS t FROM nodes WHERE timestamp IS NOT NULL), o AS (SELECT *, row_number() OVER (ORDER BY t, id) AS pos FROM n),
    m AS (SELECT a.id AS a, b.id AS b, abs(a.t - b.t) AS gap, CASE WHEN b.t < a.t OR (b.t = a.t AND b.id < a.id) THEN 'TEMPORAL_AFTER' ELSE 'TEMPORAL_BEFORE' END AS relation FROM o a JOIN o b ON b.pos BETWEEN a.pos - 6 AND a.pos + 6 AND a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY gap, b) AS r FROM m) SELECT a, b, round(gap / 1e6, 3) AS gap_s, relation FROM r WHERE r <= 6""",
)
def j11(t: Store) -> DataFrame:
    return joins.nearest_in_time(t("nodes", "id", "timestamp")).withColumn("gap_s", F.round("gap_s", 3))


@catalog(
    "j12_previous_three",
    """WITH o AS (SELECT id, row_number() OVER (ORDER BY coalesce(t_event_start, timestamp), id) AS pos FROM nodes WHERE coalesce(t_event_start, timestamp) IS NOT NULL)
    SELECT a.id AS a, b.id AS b FROM o a JOIN o b ON b.pos BETWEEN a.pos - 3 AND a.pos - 1""",
)
def j12(t: Store) -> DataFrame:
    return joins.previous_links(t("nodes", "id", "timestamp", "t_event_start"), F.coalesce("t_event_start", "timestamp"))


_UNIT = "SELECT id, timestamp, [x / sqrt(list_sum([y::DOUBLE * y FOR y IN embedding])) FOR x IN embedding]::DOUBLE[128] AS v FROM nodes WHERE len(embedding) = 128 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0"


@catalog(
    "j05_band_duplicates",
    f"""WITH u AS ({_UNIT}), o AS (SELECT *, row_number() OVER (ORDER BY id) AS pos FROM u)
    SELECT a.id AS node_a, b.id AS node_b, round(array_inner_product(a.v, b.v), 4) AS similarity FROM o a JOIN o b ON b.pos BETWEEN a.pos + 1 AND a.pos + 49 WHERE array_inner_product(a.v, b.v) >= 0.9""",
)
def j05(t: Store) -> DataFrame:
    n = t("nodes", "id", "embedding").filter(vectors.usable("embedding", 128)).select("id", "embedding")
    return band_similar(n, ["id"], 49, 0.9).select(F.col("a").alias("node_a"), F.col("b").alias("node_b"), F.round("similarity", 4).alias("similarity"))


def duplicates(t: Store, least: float = 0.95) -> DataFrame:
    """Notes at most 49 places apart by id that are nearly the same."""
    n = t("nodes", "id", "embedding").filter(vectors.usable("embedding", 128)).select("id", "embedding")
    return band_similar(n, ["id"], 49, least)


@catalog(
    "j07_band_by_time",
    f"""WITH u AS ({_UNIT}), o AS (SELECT *, row_number() OVER (ORDER BY timestamp, id) AS pos FROM u WHERE timestamp IS NOT NULL)
    SELECT a.id AS older, b.id AS newer, round(array_inner_product(a.v, b.v), 4) AS similarity FROM o a JOIN o b ON b.pos BETWEEN a.pos + 1 AND a.pos + 100 WHERE array_inner_product(a.v, b.v) >= 0.8""",
)
def j07(t: Store) -> DataFrame:
    n = t("nodes", "id", "embedding", "timestamp").filter(vectors.usable("embedding", 128)).filter("timestamp is not null")
    return band_similar(n, ["timestamp", "id"], 100, 0.8).select(F.col("a").alias("older"), F.col("b").alias("newer"), F.round("similarity", 4).alias("similarity"))


def band_similar(n: DataFrame, order: list[str], reach: int, least: float) -> DataFrame:
    """``a, b, similarity``: rows at most ``reach`` positions apart with a cosine of at least ``least``. Blocks of rows in
    order are multiplied as matrices; a block carries the ``reach`` rows behind it, so nothing is paired by a join."""
    import numpy as np
    import pyarrow as pa

    rows = joins.positions(n.select("id", "embedding", *[c for c in order if c != "id"]), order).select("id", "embedding", "pos")
    size = 8 * reach

    home = F.floor((F.col("pos") - 1) / size)
    tail = (F.col("pos") - 1) % size < reach  # the first rows of a block also close the block before
    placed = rows.withColumn("block", F.explode(F.when(tail & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        pos, ids = np.asarray(t["pos"].combine_chunks()), np.asarray(t["id"].combine_chunks())
        v = np.asarray(t["embedding"].combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        own = (pos - 1) // size == (pos[0] - 1) // size
        s = v[own] @ v.T
        gap = pos[None, :] - pos[own][:, None]
        i, j = np.nonzero((s >= least) & (gap >= 1) & (gap <= reach))
        return pa.table({"a": ids[own][i], "b": ids[j], "similarity": s[i, j]})

    return placed.groupBy("block").applyInArrow(run, "a long, b long, similarity double")
