"""Queries of the life of notes, their texts, entities and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noesis import vocabulary as V
from noesis.functions import text
from noesis.operators import edits, evaluation, lifecycle
from noesis.plans.graphs import NOW
from noesis.plans.registry import Catalog, Store

catalog = Catalog()
QUERIES, SQL = catalog.QUERIES, catalog.SQL
_q = lambda s: s.replace("'", "''")
_STOP = ", ".join(f"'{w}'" for w in V.STOPWORDS)
_VERSIONS = "v AS (SELECT user_id AS note_id, event_id AS version_number, event_type AS content FROM events)"


def _versions(t: Store) -> DataFrame:
    """Events read as versions: the user is the note."""
    return t("events", "user_id", "event_id", "event_type").select(F.col("user_id").alias("note_id"), F.col("event_id").alias("version_number"), F.col("event_type").alias("content"))


@catalog("a04_last_version", f"WITH {_VERSIONS} SELECT n.id, coalesce(max(version_number), 0) AS last FROM nodes n LEFT JOIN v ON v.note_id = n.id GROUP BY 1")
def a04(t: Store) -> DataFrame:
    return t("nodes", "id").join(lifecycle.last_version(_versions(t)).withColumnRenamed("note_id", "id"), "id", "left").select("id", F.coalesce("last", F.lit(0)).alias("last"))


@catalog("e12_kept_versions", f"WITH {_VERSIONS} SELECT note_id, version_number, content FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY version_number DESC) AS r FROM v) WHERE r <= 5")
def e12(t: Store) -> DataFrame:
    return edits.latest_versions(_versions(t), 5)


@catalog(
    "e04_updated",
    "SELECT id, CASE WHEN category = 'skill' THEN coalesce(content, '') || '!' ELSE content END AS content, CASE WHEN category = 'skill' THEN '2026-01-01 00:00:00' ELSE strftime(timestamp, '%Y-%m-%d %H:%M:%S') END AS at FROM nodes",
)
def e04(t: Store) -> DataFrame:
    """All notes of one category changed: their content and time; the versions go beside."""
    notes = t.nodes
    changes = notes.filter("category = 'skill'").select("id", F.concat(F.coalesce("content", F.lit("")), F.lit("!")).alias("content"))
    empty = t.spark.createDataFrame([], "note_id long, version_number int, content string, category string, importance string, emotional_tone string, emotional_intensity int, emotional_reflection string, created_at timestamp")
    new, _ = lifecycle.updated(notes, empty, changes, now=NOW)
    return new.select("id", "content", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


_NORMAL = r"""lower(regexp_replace(regexp_replace(trim(name), '\s+', ' ', 'g'), '^[.,;:!?''"()\[\]{}]+|[.,;:!?''"()\[\]{}]+$', '', 'g'))"""
_SYN = " ".join(f"WHEN '{_q(a)}' THEN '{_q(b)}'" for a, b in V.SYNONYMS.items())


@catalog(
    "e08_entity_ids",
    rf"""WITH e AS (SELECT id, CASE n {_SYN} ELSE n END AS n, coalesce(lower(trim(entity_type)), 'concept') AS k FROM (SELECT *, {_NORMAL} AS n FROM entities)), own AS (SELECT n, k, min(id) AS id FROM e GROUP BY 1, 2),
    a AS (SELECT DISTINCT lower(word) AS n, 'tech' AS k FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{{9,}}')) AS word FROM eval_items)), b AS (SELECT CASE n {_SYN} ELSE n END AS n, k FROM a),
    fresh AS (SELECT n, k, (SELECT max(id) FROM entities) + row_number() OVER (ORDER BY n, k) AS id FROM (SELECT DISTINCT n, k FROM b WHERE (n, k) NOT IN (SELECT (n, k) FROM own)))
    SELECT n AS name, id AS entity_id FROM b JOIN (SELECT * FROM own UNION ALL SELECT * FROM fresh) USING (n, k)""",
)
def e08(t: Store) -> DataFrame:
    """Ids of names found in texts: kept where the name and type are there, new ones behind the last."""
    found = t("eval_items", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{9,})"), F.lit(1))).alias("name")).select(F.lower("name").alias("name"), F.lit("tech").alias("entity_type"))
    _, ids = lifecycle.entity_ids(t.entities, found)
    return ids.select("name", "entity_id")


@catalog("e09_linked", "SELECT node_id, entity_id FROM node_entities UNION SELECT node_id + 1, entity_id FROM node_entities")
def e09(t: Store) -> DataFrame:
    links = t("node_entities", "node_id", "entity_id")
    return lifecycle.linked(links, links.select((F.col("node_id") + 1).alias("node_id"), "entity_id"))


@catalog("e06_touched", "SELECT id, coalesce(access_count, 0) + count(e.user_id) AS access_count, strftime(greatest(last_accessed, max(e.ts)), '%Y-%m-%d %H:%M:%S') AS at FROM nodes LEFT JOIN events e ON e.user_id = id GROUP BY id, access_count, last_accessed")
def e06(t: Store) -> DataFrame:
    """Access events added up on notes."""
    events = t("events", F.col("user_id").alias("node_id"), F.col("ts").alias("at"))
    out = edits.touched(t("nodes", "id", "access_count", "last_accessed"), events)
    return out.select("id", F.col("access_count").cast("long").alias("access_count"), F.date_format("last_accessed", "yyyy-MM-dd HH:mm:ss").alias("at"))


@catalog("e11_policies", "SELECT DISTINCT lower(trim(category)) AS category FROM nodes WHERE category IS NOT NULL AND trim(category) <> '' AND lower(trim(category)) <> 'skill'")
def e11(t: Store) -> DataFrame:
    """Policies for all categories, then one taken away."""
    none = t.spark.createDataFrame([], lifecycle.POLICY)
    added = lifecycle.policies_added(none, t("nodes", "category").filter("category is not null").withColumn("description", F.lit("")), now=NOW)
    return lifecycle.policies_removed(added, t.spark.createDataFrame([(" Skill ",)], "category string")).select("category")


@catalog(
    "e19_intentions_done",
    "SELECT id, CASE WHEN category = 'prospective' AND id % 2 = 0 THEN regexp_replace(tags, 'pending', 'done', 'g') ELSE tags END AS tags, coalesce(category = 'prospective' AND id % 2 = 0, false) AS closed FROM nodes",
)
def e19(t: Store) -> DataFrame:
    """Every second intention completed."""
    notes = t("nodes", "id", "content", "category", "tags")
    out = lifecycle.intentions_completed(notes, notes.filter("id % 2 = 0").select("id", F.lit("as planned").alias("note")))
    return out.select("id", "tags", F.coalesce(F.col("content").endswith("Completed: as planned"), F.lit(False)).alias("closed"))


@catalog("e18_to_backfill", "SELECT 'tags' AS what, count(*) AS notes FROM nodes WHERE tags IS NULL OR trim(tags) = '' UNION ALL SELECT 'vectors', count(*) FROM nodes WHERE embedding IS NULL OR len(embedding) <> 128 UNION ALL SELECT 'times', count(*) FROM nodes WHERE t_event_start IS NULL AND temporal_expressions IS NULL UNION ALL SELECT 'entities', count(*) FROM nodes WHERE id NOT IN (SELECT node_id FROM node_entities WHERE node_id IS NOT NULL)")
def e18(t: Store) -> DataFrame:
    out = None
    for what in ("tags", "vectors", "times", "entities"):
        row = lifecycle.missing(t.nodes, what, links=t("node_entities", "node_id")).agg(F.count(F.lit(1)).alias("notes")).select(F.lit(what).alias("what"), "notes")
        out = row if out is None else out.unionByName(row)
    return out


@catalog("e21_chunk_links")
def e21(t: Store) -> DataFrame:
    """Chunks of long notes and the chain between them."""
    parts, links = lifecycle.chunks(t("nodes", "id", "content"), parents=False)
    return parts.join(links.select("parent", "chunk_no", "edge_type"), ["parent", "chunk_no"], "left").select("parent", "chunk_no", F.length("content").alias("chars"), "edge_type")


_UNIT = "SELECT id, category, [x / sqrt(list_sum([y::DOUBLE * y FOR y IN embedding])) FOR x IN embedding]::DOUBLE[128] AS v FROM nodes WHERE len(embedding) = 128 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0"


@catalog(
    "e22_mini_consolidation",
    f"""WITH u AS ({_UNIT}), r AS (SELECT a.id AS s, b.id AS t, array_inner_product(a.v, b.v) AS c, row_number() OVER (PARTITION BY a.id ORDER BY array_inner_product(a.v, b.v) DESC, b.id) AS r FROM u a JOIN u b ON a.category = 'breakthrough' AND a.id <> b.id)
    SELECT s AS source_id, t AS target_id, 'consolidation' AS edge_type, round((1 + c) / 2, 4) AS weight FROM r WHERE r <= 16 AND (1 + c) / 2 >= 0.75""",
)
def e22(t: Store) -> DataFrame:
    notes = t("nodes", "id", "category", "embedding")
    return lifecycle.mini_consolidation(notes.filter("category = 'breakthrough'"), notes).withColumn("weight", F.round("weight", 4))


@catalog(
    "q01_co_mention_edges",
    """WITH n AS (SELECT DISTINCT node_id, entity_id FROM node_entities WHERE node_id IN (SELECT id FROM nodes WHERE category = 'breakthrough')), m AS (SELECT n.node_id AS a, l.node_id AS b FROM n JOIN node_entities l USING (entity_id) WHERE l.node_id <> n.node_id)
    SELECT a AS source_id, b AS target_id, 'entity' AS edge_type, 0.6::DOUBLE AS weight FROM m UNION SELECT b, a, 'entity', 0.6::DOUBLE FROM m""",
)
def q01(t: Store) -> DataFrame:
    """Entity edges that new notes of one category would bring."""
    links = t("node_entities", "node_id", "entity_id")
    new = links.join(t("nodes", F.col("id").alias("node_id"), "category").filter("category = 'breakthrough'").select("node_id"), "node_id", "left_semi")
    return lifecycle.co_mention_edges(links, new)


@catalog("s16_journal", "WITH j AS (SELECT id, timestamp, content, row_number() OVER (ORDER BY timestamp DESC NULLS LAST, id DESC) AS place FROM nodes WHERE category = 'working-memory') SELECT place::INTEGER AS place, id, CASE WHEN place = 1 THEN content ELSE substring(content, 1, 150) END AS content FROM j WHERE place <= 3")
def s16(t: Store) -> DataFrame:
    return lifecycle.journal(t("nodes", "id", "category", "timestamp", "content")).select("place", "id", "content")


@catalog(
    "j18_relation_rows",
    """WITH l AS (SELECT DISTINCT node_id, lower(name) AS name FROM node_entities JOIN entities e ON e.id = entity_id), x AS (SELECT node_id, min(name) AS h, max(name) || CASE WHEN node_id % 3 = 0 THEN '?' ELSE '' END AS q FROM l GROUP BY 1),
    i AS (SELECT name, list(node_id ORDER BY node_id)[1:3] AS ids FROM l GROUP BY 1), y AS (SELECT node_id, a.ids AS hs, b.ids AS qs FROM x LEFT JOIN i a ON a.name = h LEFT JOIN i b ON b.name = q WHERE a.ids IS NOT NULL OR b.ids IS NOT NULL),
    z AS (SELECT unnest(coalesce(hs, [node_id])) AS s, coalesce(qs, [node_id]) AS qs FROM y), o AS (SELECT s, unnest(qs) AS t FROM z) SELECT DISTINCT s AS source_id, t AS target_id, 'related_to' AS edge_type FROM o WHERE s <> t""",
)
def j18(t: Store) -> DataFrame:
    """Triples of each note's first and last entity, a third of them with an unknown end, as edges."""
    from noesis.plans.upkeep import relation_rows

    names = t("node_entities", "node_id", "entity_id").join(t("entities", F.col("id").alias("entity_id"), F.lower("name").alias("name")), "entity_id")
    x = names.groupBy("node_id").agg(F.min("name").alias("head"), F.max("name").alias("tail"))
    x = x.withColumn("tail", F.concat("tail", F.when(F.col("node_id") % 3 == 0, "?").otherwise(""))).withColumn("relation", F.lit("related_to"))
    return relation_rows(t, x)


@catalog("l02_summary_tokens", f"SELECT id, len([x FOR x IN regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+') IF length(x) > 1 AND x NOT IN ({_STOP})])::INTEGER AS tokens FROM nodes")
def l02(t: Store) -> DataFrame:
    return t("nodes", "id", "content").select("id", F.size(text.summary_tokens("content")).alias("tokens"))


_W = r"\p{L}\p{N}_"
_KNOWN = ", ".join(
    "CASE WHEN " + (f"regexp_matches(lower(text), '(?:^|[^{_W}]){_q(k).replace('+', chr(92) + '+')}(?:$|[^{_W}])')" if len(k) <= 3 else f"contains(lower(text), '{_q(k)}')") + f" THEN '{_q(n)}' END"
    for table in V.KNOWN.values() for k, n in table.items()
)


@catalog("l09_known_entities", f"SELECT doc_id, array_to_string(list_sort(list_distinct([x FOR x IN [{_KNOWN}] IF x IS NOT NULL])), '|') AS names FROM documents WHERE text IS NOT NULL")
def l09(t: Store) -> DataFrame:
    return t("documents", "doc_id", "text").filter("text is not null").select("doc_id", F.array_join(F.array_sort(text.known_entities("text")), "|").alias("names"))


@catalog(
    "m03_tag_terms",
    f"""WITH w AS (SELECT id, unnest(regexp_extract_all(lower(content), '[a-zA-Zа-яА-ЯёЁ0-9_]+')) AS term FROM nodes), c AS (SELECT id, term, count(*) AS f FROM w WHERE length(term) > 2 AND term NOT IN ({_STOP}) GROUP BY 1, 2),
    d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), s AS (SELECT id, term, round(f * ln(((SELECT count(*) FROM nodes) + 1) / (df + 1)), 9) AS weight FROM c JOIN d USING (term)), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS r FROM s)
    SELECT id, term, round(weight, 5) AS weight FROM r WHERE r <= 3""",
)
def m03(t: Store) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("weight"), "term")
    return lifecycle.term_weights(t("nodes", "id", "content")).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("id", "term", F.round("weight", 5).alias("weight"))


@catalog("l16_tags")
def l16(t: Store) -> DataFrame:
    """Tags for every note from its category, importance, entities and words."""
    return lifecycle.tags(t("nodes", "id", "category", "importance", "content"), t("node_entities", "node_id", "entity_id"), t("entities", "id", "name"))


@catalog("l17_questions")
def l17(t: Store) -> DataFrame:
    """A question per note, made without a model."""
    return evaluation.questions(t("nodes", "id", "content"), t("node_entities", "node_id", "entity_id"), t("entities", "id", "name", "entity_type"))


@catalog("y04_json", "SELECT id, coalesce(len(temporal_expressions), 0)::INTEGER AS n, to_json(temporal_expressions)::VARCHAR AS expressions FROM nodes WHERE temporal_expressions IS NOT NULL")
def y04(t: Store) -> DataFrame:
    """Lists written as JSON and read back."""
    n = t("nodes", "id", "temporal_expressions").filter("temporal_expressions is not null").withColumn("expressions", F.to_json("temporal_expressions"))
    return n.select("id", F.size(F.from_json("expressions", "array<string>")).alias("n"), "expressions")


@catalog("m07_shifted_cosine", "SELECT id, round((1 + similarity) / 2, 6) AS score FROM contradiction_log WHERE similarity IS NOT NULL")
def m07(t: Store) -> DataFrame:
    return t("contradiction_log", "id", "similarity").filter("similarity is not null").select("id", F.round(lifecycle.shifted_cosine(F.col("similarity")), 6).alias("score"))


@catalog("d02_event_times")
def d02(t: Store) -> DataFrame:
    """Time expressions of every note and the range they mean, counted from the note's own time."""
    from noesis.functions.times import event_times

    notes = t("nodes", "id", "content", "timestamp")
    return event_times(notes, "id", "content", F.coalesce("timestamp", F.lit(NOW).cast("timestamp")))


@catalog("s08_export_counts", "SELECT 'nodes' AS part, count(*) AS rows FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'node_entities', count(*) FROM node_entities")
def s08(t: Store) -> DataFrame:
    """The tables exported as JSON and read again."""
    import os
    import uuid

    from noesis.session import shared_dir
    from noesis.sources.exchange import TABLES, export_json

    target = os.path.join(shared_dir(t.spark), f"noesis-export-{uuid.uuid4().hex}")
    export_json(t.spark, t.base, target)
    out = None
    for name in TABLES:
        row = t.spark.read.json(f"{target}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = row if out is None else out.unionByName(row)
    return out
