"""Text, date and table-change queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noesis import vocabulary as V
from noesis.functions import scanner, text, times
from noesis.operators import access, edits
from noesis.plans.registry import Catalog, Store

catalog = Catalog()
QUERIES, SQL = catalog.QUERIES, catalog.SQL
CUTOFF = "2025-06-01 00:00:00"
_q = lambda s: s.replace("'", "''")


@catalog("l01_token_counts", "SELECT id, len(regexp_extract_all(lower(content), '[a-zA-Zа-яА-ЯёЁ0-9_]+'))::INTEGER AS tokens FROM nodes")
def l01(t: Store) -> DataFrame:
    return t("nodes", "id", "content").select("id", F.size(text.tokens("content")).alias("tokens"))


@catalog("l03_topic_words", "SELECT category, term, count(*) AS n FROM (SELECT category, unnest(regexp_extract_all(lower(content), '[a-zA-ZЀ-ӿ]{4,}')) AS term FROM nodes) GROUP BY 1, 2")
def l03(t: Store) -> DataFrame:
    return t("nodes", "category", "content").select("category", F.explode(text.topic_words("content")).alias("term")).groupBy("category", "term").agg(F.count(F.lit(1)).alias("n"))


@catalog(
    "l06_script",
    r"""SELECT id, CASE WHEN length(regexp_replace(content, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(content, '[^\p{L}]', '', 'g')) - length(regexp_replace(content, '[^a-zA-Z]', '', 'g')) > length(regexp_replace(content, '[^\p{L}]', '', 'g')) * 0.2 THEN 'xx' ELSE 'en' END AS script FROM nodes""",
)
def l06(t: Store) -> DataFrame:
    return t("nodes", "id", "content").select("id", text.script_language("content").alias("script"))


_SYNONYMS = " ".join(f"WHEN '{_q(a)}' THEN '{_q(b)}'" for a, b in V.SYNONYMS.items())


@catalog("l07_normal_names", rf"""SELECT id, CASE n {_SYNONYMS} ELSE n END AS name FROM (SELECT id, lower(regexp_replace(regexp_replace(trim(name), '\s+', ' ', 'g'), '^[.,;:!?''"()\[\]{{}}]+|[.,;:!?''"()\[\]{{}}]+$', '', 'g')) AS n FROM entities)""")
def l07(t: Store) -> DataFrame:
    return t("entities", "id", "name").select("id", text.normal_name("name").alias("name"))


_TONES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.TONES.items())


@catalog("l08_tones", f"SELECT tone, count(*) AS notes FROM (SELECT CASE x {_TONES} ELSE x END AS tone FROM (SELECT lower(trim(unnest(string_split(emotional_tone, ',')))) AS x FROM nodes)) GROUP BY 1")
def l08(t: Store) -> DataFrame:
    return t("nodes", "emotional_tone").select(F.explode(F.split("emotional_tone", ",")).alias("x")).select(text.normal_tone("x").alias("tone")).groupBy("tone").agg(F.count(F.lit(1)).alias("notes"))


@catalog("l10_keys", r"SELECT id, len(list_distinct(regexp_extract_all(lower(content), '[\p{L}]{6,}')))::INTEGER AS words, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '[0-9]+(?:[.,][0-9]+)? ?(?:%|ms|GB|MB|s|h|x)'))), '|') AS numbers FROM nodes")
def l10(t: Store) -> DataFrame:
    words = F.size(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"([\p{L}]{6,})"), F.lit(1))))
    return t("nodes", "id", "content").select("id", words.alias("words"), F.array_join(F.array_sort(text.number_keys("content")), "|").alias("numbers"))


def _signal_sql(lang: str, phrase: str) -> str:
    return f"CASE WHEN regexp_matches(lower(content), '{_q(text.signal_pattern(lang, phrase))}') THEN '{_q(phrase)}' END"


_ALL_SIGNALS = ", ".join(_signal_sql(lang, p) for lang, ps in text.SIGNALS.items() for p in ps)


@catalog("l11_signals", f"SELECT id, array_to_string(list_sort(list_distinct([x FOR x IN [{_ALL_SIGNALS}] IF x IS NOT NULL])), '; ') AS signals FROM nodes")
def l11(t: Store) -> DataFrame:
    return t("nodes", "id", "content").select("id", F.array_join(F.array_sort(text.signals("content")), "; ").alias("signals"))


def _sql_threats(level: str) -> str:
    flags = "is" if level == "high" else "i"
    parts = []
    for p, _ in scanner.THREATS[level]:
        if "(?!" in p:  # RE2 has no lookahead: what may follow is cut off before, and the rest searched
            head, tail = p.split("(?!", 1)
            allowed = tail[:-1]
            parts.append(f"regexp_matches(regexp_replace(text, '{_q(head)}(?:{_q(allowed)})', '', 'gi'), '{_q(head)}', '{flags}')")
        else:
            parts.append(f"regexp_matches(text, '{_q(p)}', '{flags}')")
    return " OR ".join(parts)


@catalog("l12_threats", "SELECT doc_id, CASE WHEN text IS NULL THEN NULL " + " ".join(f"WHEN {_sql_threats(k)} THEN '{k}'" for k in scanner.LEVELS) + " ELSE 'safe' END AS level FROM documents")
def l12(t: Store) -> DataFrame:
    return t("documents", "doc_id", "text").select("doc_id", scanner.threat_level("text").alias("level"))


@catalog("l12_findings")
def l12f(t: Store) -> DataFrame:
    """Every finding of the scanner with its place."""
    return scanner.findings(t("documents", "doc_id", "text"), "doc_id", "text")


@catalog("l12_stripped", f"SELECT doc_id, regexp_replace(text, '{scanner.STRIPPED_TAGS}', '[STRIPPED]', 'gi') AS text FROM documents")
def l12s(t: Store) -> DataFrame:
    return t("documents", "doc_id", "text").select("doc_id", scanner.stripped("text").alias("text"))


@catalog("l15_remember_blocks", "SELECT doc_id, len(regexp_extract_all(text, '(?s)\\[REMEMBER:[^\\]]*\\](.*?)\\[/REMEMBER\\]'))::INTEGER AS blocks FROM documents")
def l15(t: Store) -> DataFrame:
    return t("documents", "doc_id", "text").select("doc_id", F.size(text.remember_blocks("text")).alias("blocks")).withColumn("blocks", F.when(F.col("blocks") >= 0, F.col("blocks")))


@catalog("l18_plain", r"SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')) AS plain FROM eval_items")
def l18(t: Store) -> DataFrame:
    return t("eval_items", "item_id", "text").select("item_id", text.plain("text").alias("plain"))


@catalog("l05_chunks")
def l05(t: Store) -> DataFrame:
    return t("documents", "doc_id", "text").select("doc_id", F.posexplode(text.chunk_column("text")).alias("chunk_no", "chunk"))


@catalog("d01_iso_dates", r"SELECT doc_id, len([x FOR x IN regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') IF try_cast(x AS DATE) IS NOT NULL])::INTEGER AS dates FROM documents WHERE text IS NOT NULL")
def d01(t: Store) -> DataFrame:
    return t("documents", "doc_id", "text").filter("text is not null").select("doc_id", F.size(times.iso_dates("text")).alias("dates"))


@catalog("d04_age_days", f"SELECT id, CAST(floor((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(timestamp)) / 86400000000.0) AS BIGINT) AS days FROM nodes WHERE timestamp IS NOT NULL")
def d04(t: Store) -> DataFrame:
    return t("nodes", "id", "timestamp").filter("timestamp is not null").select("id", times.whole_days(F.col("timestamp"), "2026-01-01 00:00:00").alias("days"))


@catalog("y01_tag_lists", "SELECT tag, count(*) AS notes FROM (SELECT trim(unnest(string_split(tags, ' '))) AS tag FROM nodes WHERE tags IS NOT NULL) WHERE tag <> '' GROUP BY 1")
def y01(t: Store) -> DataFrame:
    parts = t("nodes", "tags").filter("tags is not null").select(F.explode(F.split("tags", " ")).alias("tag")).select(F.trim("tag").alias("tag"))
    return parts.filter("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("notes"))


@catalog(
    "y03_top_terms",
    """WITH w AS (SELECT category, unnest(regexp_extract_all(lower(content), '[a-zA-ZЀ-ӿ]{4,}')) AS term FROM nodes WHERE category IS NOT NULL), c AS (SELECT category, term, count(*) AS n FROM w GROUP BY 1, 2)
    SELECT category, term, n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, term) AS r FROM c) WHERE r <= 5""",
)
def y03(t: Store) -> DataFrame:
    from pyspark.sql import Window

    c = l03(t).filter("category is not null")
    return c.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "term"))).filter("r <= 5").drop("r")


_NEW = "n AS (SELECT target_id AS source_id, source_id AS target_id, edge_type, weight * 0.9 AS weight, created_at FROM edges)"


def reversed_edges(t: Store) -> DataFrame:
    e = t.edges
    return e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "edge_type", (F.col("weight") * 0.9).alias("weight"), "created_at")


@catalog("e02_upsert", f"WITH {_NEW}, b AS (SELECT source_id, target_id, edge_type, weight FROM edges UNION ALL SELECT source_id, target_id, edge_type, weight FROM n) SELECT source_id, target_id, edge_type, round(max(weight), 6) AS weight FROM b GROUP BY 1, 2, 3")
def e02(t: Store) -> DataFrame:
    return edits.upsert_edges(t.edges, reversed_edges(t)).select("source_id", "target_id", "edge_type", F.round("weight", 6).alias("weight"))


@catalog("e03_insert_or_ignore", f"WITH {_NEW} SELECT source_id, target_id, edge_type, round(max(weight), 6) AS weight FROM n WHERE (source_id, target_id, edge_type) NOT IN (SELECT (source_id, target_id, edge_type) FROM edges) GROUP BY 1, 2, 3")
def e03(t: Store) -> DataFrame:
    return edits.insert_edges(t.edges, reversed_edges(t)).select("source_id", "target_id", "edge_type", F.round("weight", 6).alias("weight"))


_GONE = "g AS (SELECT id FROM nodes WHERE importance = 'low')"


@catalog("e05_delete_cascade", f"WITH {_GONE} SELECT 'nodes' AS part, count(*) AS rows FROM nodes WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'edges', count(*) FROM edges WHERE source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'links', count(*) FROM node_entities WHERE node_id NOT IN (SELECT id FROM g)")
def e05(t: Store) -> DataFrame:
    gone = t("nodes", "id", "importance").filter("importance = 'low'").select("id")
    parts = edits.delete_notes(t("nodes", "id"), t("edges", "source_id", "target_id"), t("node_entities", "node_id", "entity_id"), gone)
    out = None
    for name, df in zip(("nodes", "edges", "links"), parts):
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


@catalog(
    "e10_merge_entities",
    """WITH m AS (SELECT id AS remove_id, min(id) OVER (PARTITION BY lower(trim(name))) AS keep_id FROM entities WHERE name IS NOT NULL), d AS (SELECT * FROM m WHERE remove_id <> keep_id)
    SELECT DISTINCT node_id, coalesce(keep_id, entity_id) AS entity_id FROM node_entities LEFT JOIN d ON d.remove_id = entity_id""",
)
def e10(t: Store) -> DataFrame:
    e = t("entities", "id", "name").filter("name is not null").withColumn("k", F.lower(F.trim("name")))
    keep = e.groupBy("k").agg(F.min("id").alias("keep_id"))
    mapping = e.join(keep, "k").filter("id <> keep_id").select(F.col("id").alias("remove_id"), "keep_id")
    return edits.merge_entities(t("entities", "id"), t("node_entities", "node_id", "entity_id"), mapping)[1]


@catalog("e13_prune", "SELECT source_id, target_id, edge_type, weight FROM edges WHERE NOT (edge_type = 'semantic' AND weight < 0.5)")
def e13(t: Store) -> DataFrame:
    return edits.pruned(t("edges", "source_id", "target_id", "edge_type", "weight"), 0.5)


_quoted = ", ".join(f"'{c}'" for c in V.PROTECTED)
_words = " OR ".join(f"contains(lower(category), '{w}')" for w in V.PROTECTED_WORDS)


@catalog(
    "e14_decay",
    f"""WITH p AS (SELECT id FROM nodes WHERE lower(category) IN ({_quoted})) SELECT source_id, target_id, edge_type,
    round(CASE WHEN created_at < TIMESTAMP '{CUTOFF}' AND weight > 0.3 AND source_id NOT IN (SELECT id FROM p) AND target_id NOT IN (SELECT id FROM p) THEN weight * 0.95 ELSE weight END, 6) AS weight FROM edges""",
)
def e14(t: Store) -> DataFrame:
    safe = t("nodes", "id", "category").filter(F.lower("category").isin(V.PROTECTED)).select("id")
    out = edits.decayed(t("edges", "source_id", "target_id", "edge_type", "weight", "created_at"), safe, access.stale("created_at", "weight", CUTOFF))
    return out.select("source_id", "target_id", "edge_type", F.round("weight", 6).alias("weight"))


@catalog(
    "e15_boost",
    f"""WITH c AS (SELECT DISTINCT lower(category) AS c FROM nodes WHERE category IS NOT NULL AND (lower(trim(importance)) = 'critical' OR {_words}) UNION SELECT unnest([{_quoted}]))
    SELECT id, CASE WHEN lower(category) IN (SELECT c FROM c) THEN 'critical' ELSE importance END AS importance FROM nodes""",
)
def e15(t: Store) -> DataFrame:
    n = t("nodes", "id", "category", "importance")
    return edits.boosted(n, access.protected_categories(n)).select("id", "importance")


@catalog(
    "e16_prospective",
    r"""WITH p AS (SELECT id, content, importance, coalesce(tags, '') AS g, category = 'prospective' AS mine FROM nodes)
    SELECT id, CASE WHEN mine AND contains(g, 'pending') THEN 'critical' WHEN mine AND (contains(g, 'done') OR contains(g, 'cancelled')) AND importance = 'critical' THEN 'low' ELSE importance END AS importance,
    coalesce(mine AND contains(g, 'pending') AND regexp_extract(g, 'due:([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) <> '' AND regexp_extract(g, 'due:([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) < '2025-06-01' AND NOT contains(content, 'OVERDUE'), false) AS overdue FROM p""",
)
def e16(t: Store) -> DataFrame:
    n = t("nodes", "id", "content", "importance", "tags", "category")
    return edits.prospective(n, "2025-06-01").select("id", "importance", F.col("content").startswith("[OVERDUE] ").alias("overdue"))
