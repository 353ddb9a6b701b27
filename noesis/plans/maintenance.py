"""The batch upkeep of the graph: steps that read tables and return what they would add or change.

A step is a function of a Store and returns a frame of new edges (source_id, target_id, edge_type, weight) or of the rows it
would write; ``upkeep.run`` applies them in their fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noesis import vocabulary as V
from noesis.functions import text, vectors
from noesis.operators import graph, joins, lifecycle, similarity, text_index
from noesis.operators import kmeans as kmeans_rows
from noesis.plans import relational
from noesis.plans.registry import Catalog, Store
from noesis.plans.relational import band_similar, temporal_chains
from noesis.session import cut

catalog = Catalog()
QUERIES, SQL = catalog.QUERIES, catalog.SQL
OUT = ["source_id", "target_id", "edge_type", "weight"]
SQL_CHAINS = relational.SQL["w01_temporal_chains"].replace("SELECT category, id AS source_id, next AS target_id", "SELECT id AS source_id, next AS target_id, 'temporal_chain' AS edge_type, 0.95::DOUBLE AS weight")


def _both_ways(pairs: DataFrame, kind: str, weight) -> DataFrame:
    one = pairs.select("source_id", "target_id", F.lit(kind).alias("edge_type"), weight.cast("double").alias("weight"))
    return one.unionByName(one.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "edge_type", "weight"))


def usable_notes(t: Store, *columns: str) -> DataFrame:
    return t("nodes", "id", "embedding", *columns).filter(vectors.usable("embedding", 128))


@catalog("m01_thematic_links")
def thematic(t: Store) -> DataFrame:
    """Leader clusters of similar notes and their links."""
    notes = usable_notes(t)
    clusters = graph.leader_clusters(notes.select("id"), similarity.similar_pairs(notes, "id", "embedding", least=0.75))
    return _both_ways(graph.cluster_links(clusters), "consolidation", F.lit(0.9))


@catalog("m01_chains", SQL_CHAINS)
def chains(t: Store) -> DataFrame:
    c = temporal_chains(t("nodes", "id", "category", "timestamp"))
    return c.select("source_id", "target_id", F.lit("temporal_chain").alias("edge_type"), F.lit(0.95).cast("double").alias("weight"))


_UNIT = "SELECT id, category, content, importance, timestamp, [x / sqrt(list_sum([y::DOUBLE * y FOR y IN embedding])) FOR x IN embedding]::DOUBLE[128] AS v FROM nodes WHERE len(embedding) = 128 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0"


@catalog("j04_similar_pairs", f"WITH u AS ({_UNIT}) SELECT a.id AS a, b.id AS b, round(array_inner_product(a.v, b.v), 4) AS similarity FROM u a JOIN u b ON a.id < b.id WHERE array_inner_product(a.v, b.v) >= 0.85")
def j04(t: Store) -> DataFrame:
    return similarity.similar_pairs(usable_notes(t), "id", "embedding", least=0.85).withColumn("similarity", F.round("similarity", 4))


_COUNT = " + ".join(f"regexp_matches(lower(content), '{text.signal_pattern(lang, p).replace(chr(39), chr(39) * 2)}')::INT" for lang, ps in text.SIGNALS.items() for p in ps)


@catalog(
    "m03_contradictions",
    f"""WITH u AS ({_UNIT}), o AS (SELECT *, row_number() OVER (ORDER BY timestamp, id) AS pos FROM u WHERE timestamp IS NOT NULL),
    s AS (SELECT a.id AS older, b.id AS newer, array_inner_product(a.v, b.v) AS c FROM o a JOIN o b ON b.pos BETWEEN a.pos + 1 AND a.pos + 100 WHERE array_inner_product(a.v, b.v) >= 0.8),
    g AS (SELECT id, {_COUNT} AS n FROM nodes)
    SELECT older AS source_id, newer AS target_id, round(c, 4) AS similarity, round(c * least((x.n + y.n) / 3.0, 1.0), 4) AS severity FROM s JOIN g x ON x.id = older JOIN g y ON y.id = newer WHERE x.n + y.n > 0""",
)
def contradictions(t: Store) -> DataFrame:
    """Similar notes near in time of which one says that something changed; severity grows with the signals of both, up to
    three."""
    return found_contradictions(t).select("source_id", "target_id", F.round("similarity", 4).alias("similarity"), F.round("severity", 4).alias("severity"))


def found_contradictions(t: Store) -> DataFrame:
    """``source_id`` (older), ``target_id`` (newer), similarity, severity, signals (up to five)."""
    pairs = band_similar(usable_notes(t, "timestamp").filter("timestamp is not null"), ["timestamp", "id"], 100, 0.8)
    # only notes of a pair are searched for signals
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = cut(t("nodes", "id", "content").join(ends, "id", "left_semi").select("id", text.signals("content").alias("s"), text.signal_count("content").alias("n")).filter("n > 0"), "signals")
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("id").alias(side), F.col("s").alias(f"s{side}"), F.col("n").alias(f"n{side}")), side, "left")
    none = F.array().cast("array<string>")
    n = F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0))
    severity = F.col("similarity") * F.least(n / 3.0, F.lit(1.0))
    signals = F.slice(F.array_distinct(F.concat(F.coalesce("sa", none), F.coalesce("sb", none))), 1, 5)
    return pairs.filter(n > 0).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "similarity", severity.alias("severity"), signals.alias("signals"))


@catalog("j08_identity_pairs", f"WITH u AS (SELECT * FROM ({_UNIT}) WHERE category IN ({', '.join(repr(c) for c in V.IDENTITY)})) SELECT a.id AS a, b.id AS b, round(array_inner_product(a.v, b.v), 4) AS similarity FROM u a JOIN u b ON a.id < b.id WHERE array_inner_product(a.v, b.v) >= 0.7")
def identity(t: Store, least: float = 0.7) -> DataFrame:
    notes = usable_notes(t, "category").filter(F.col("category").isin(V.IDENTITY))
    return similarity.similar_pairs(notes, "id", "embedding", least=least).withColumn("similarity", F.round("similarity", 4))


@catalog("j08_identity_conflicts", f"WITH u AS (SELECT * FROM ({_UNIT}) WHERE category IN ({', '.join(repr(c) for c in V.IDENTITY)})) SELECT a.id AS a, b.id AS b, round(array_inner_product(a.v, b.v), 4) AS similarity FROM u a JOIN u b ON a.id < b.id WHERE array_inner_product(a.v, b.v) >= 0.5")
def identity_conflicts(t: Store) -> DataFrame:
    """Identity pairs at the reference's bound; ``j08_identity_pairs`` has a narrower one."""
    return identity(t, 0.5)


@catalog(
    "j09_generalises",
    f"""WITH u AS ({_UNIT}), s AS (SELECT a.id AS source_id, b.id AS target_id, array_inner_product(a.v, b.v) AS c FROM u a JOIN u b ON a.category IN ({', '.join(repr(c) for c in V.CONCRETE)}) AND b.category IN ({', '.join(repr(c) for c in V.ABSTRACT)})),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY c DESC, target_id DESC) AS r FROM s WHERE c >= 0.65) SELECT source_id, target_id, round(c, 3) AS weight FROM r WHERE r <= 3""",
)
def generalises(t: Store) -> DataFrame:
    """Up to three abstract notes per concrete one."""
    notes = usable_notes(t, "category").filter(F.col("category").isin(V.CONCRETE + V.ABSTRACT)).withColumn("concrete", F.col("category").isin(V.CONCRETE))
    pairs = similarity.similar_pairs(notes, "id", "embedding", least=0.65, sides="concrete")
    side = pairs.join(notes.filter("concrete").select(F.col("id").alias("a"), F.lit(True).alias("first")), "a", "left")
    one = side.select(F.when(F.col("first"), F.col("a")).otherwise(F.col("b")).alias("source_id"), F.when(F.col("first"), F.col("b")).otherwise(F.col("a")).alias("target_id"), "similarity")
    best = Window.partitionBy("source_id").orderBy(F.desc("similarity"), F.desc("target_id"))
    return one.withColumn("r", F.row_number().over(best)).filter("r <= 3").select("source_id", "target_id", F.round("similarity", 3).alias("weight"))


def resonance(t: Store) -> DataFrame:
    from noesis.plans.relational import j10

    return _both_ways(j10(t).select(F.col("node_a").alias("source_id"), F.col("node_b").alias("target_id"), "weight"), "EMOTIONAL_RESONANCE", F.col("weight"))


@catalog(
    "j06_supersedes",
    f"""WITH u AS ({_UNIT}), o AS (SELECT *, row_number() OVER (ORDER BY timestamp, id) AS pos FROM u WHERE timestamp IS NOT NULL),
    s AS (SELECT a.id AS older, b.id AS newer, array_inner_product(a.v, b.v) AS c FROM o a JOIN o b ON b.pos BETWEEN a.pos + 1 AND a.pos + 99 WHERE array_inner_product(a.v, b.v) >= 0.85 AND a.timestamp <> b.timestamp AND coalesce(a.importance, '') <> 'critical'),
    n AS (SELECT DISTINCT source_id AS id, target_id AS x FROM edges WHERE edge_type = 'entity' UNION SELECT target_id, source_id FROM edges WHERE edge_type = 'entity')
    SELECT DISTINCT newer AS source_id, older AS target_id, round(c, 4) AS weight FROM s JOIN n p ON p.id = older JOIN n q ON q.id = newer AND q.x = p.x""",
)
def supersedes(t: Store) -> DataFrame:
    """A newer similar note that shares a neighbour by entity takes the place of an older one that is not critical."""
    notes = usable_notes(t, "timestamp", "importance").filter("timestamp is not null")
    pairs = band_similar(notes, ["timestamp", "id"], 99, 0.85)
    plain = t("nodes", "id", "timestamp", "importance")
    pairs = pairs.join(plain.select(F.col("id").alias("a"), F.col("timestamp").alias("ta"), "importance"), "a").join(plain.select(F.col("id").alias("b"), F.col("timestamp").alias("tb")), "b")
    pairs = pairs.filter((F.col("ta") != F.col("tb")) & (F.coalesce("importance", F.lit("")) != "critical"))
    near = joins.adjacency(t("edges", "source_id", "target_id", "weight", "edge_type").filter("edge_type = 'entity'")).select("src", "dst").distinct()
    met = pairs.join(near.select(F.col("src").alias("a"), F.col("dst").alias("x")), "a").join(near.select(F.col("src").alias("b"), F.col("dst").alias("x")), ["b", "x"])
    return met.select(F.col("b").alias("source_id"), F.col("a").alias("target_id"), F.round("similarity", 4).alias("weight")).distinct()


_ONCE = "l AS (SELECT DISTINCT node_id, entity_id FROM node_entities), few AS (SELECT entity_id FROM l GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), k AS (SELECT * FROM l WHERE entity_id IN (SELECT entity_id FROM few))"


@catalog(
    "j19_entity_relations",
    f"""WITH {_ONCE} SELECT DISTINCT a.node_id AS source_id, b.node_id AS target_id, CASE WHEN lower(trim(e.entity_type)) = 'tech' THEN 'depends_on' ELSE 'related_to' END AS edge_type FROM k a JOIN k b USING (entity_id) JOIN entities e ON e.id = entity_id
    WHERE a.node_id < b.node_id AND (a.node_id, b.node_id) NOT IN (SELECT (source_id, target_id) FROM edges)""",
)
def entity_relations(t: Store) -> DataFrame:
    """Typed edges between notes that share an entity and have no edge in that direction yet."""
    links = t("node_entities", "node_id", "entity_id").distinct()
    few = links.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n between 2 and 50").select("entity_id")
    kinds = t("entities", F.col("id").alias("entity_id"), "entity_type")
    k = links.join(few, "entity_id").join(kinds, "entity_id")
    kind = F.when(F.lower(F.trim("entity_type")) == "tech", "depends_on").otherwise("related_to")
    pairs = k.select("entity_id", F.col("node_id").alias("source_id"), kind.alias("edge_type")).join(k.select("entity_id", F.col("node_id").alias("target_id")), "entity_id").filter("source_id < target_id")
    return pairs.select("source_id", "target_id", "edge_type").distinct().join(t("edges", "source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti")


@catalog(
    "j19_hub_relations",
    """WITH l AS (SELECT DISTINCT node_id, entity_id FROM node_entities WHERE node_id IS NOT NULL), many AS (SELECT entity_id FROM l GROUP BY 1 HAVING count(*) > 50)
    SELECT entity_id, node_id, CASE WHEN lower(trim(e.entity_type)) = 'tech' THEN 'depends_on' ELSE 'related_to' END AS edge_type FROM l JOIN many USING (entity_id) JOIN entities e ON e.id = entity_id""",
)
def hub_relations(t: Store) -> DataFrame:
    """The relations of entities on more than 50 notes, in linear form: any two members of an entity, smaller id first, are
    related by its edge_type unless they have an edge in that direction; ``hub_pairs`` writes them out."""
    links = t("node_entities", "node_id", "entity_id").filter("node_id is not null").distinct()
    many = links.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 50").select("entity_id")
    kind = F.when(F.lower(F.trim("entity_type")) == "tech", "depends_on").otherwise("related_to")
    return links.join(many, "entity_id").join(t("entities", F.col("id").alias("entity_id"), kind.alias("edge_type")), "entity_id").select("entity_id", "node_id", "edge_type")


def hub_pairs(t: Store, sources: DataFrame | None = None) -> DataFrame:
    """``hub_relations`` as pairs, of all notes or those of ``sources`` (id): without existing edges. Their number grows with
    the square of an entity's notes, so members are dealt over tasks."""
    members = hub_relations(t)
    first = members.select("entity_id", F.col("node_id").alias("source_id"), "edge_type")
    if sources is not None:
        first = first.join(sources.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    deal = 16
    first = first.withColumn("part", F.pmod(F.xxhash64("source_id"), F.lit(deal)))
    second = members.select("entity_id", F.col("node_id").alias("target_id"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(deal)])).alias("part"))
    pairs = first.join(second, ["entity_id", "part"]).filter("source_id < target_id").select("source_id", "target_id", "edge_type").distinct()
    return pairs.join(t("edges", "source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti")


@catalog("m18_topics", """WITH w AS (SELECT representative_node_id AS id, cluster_hash, top_terms FROM cluster_summaries WHERE top_terms IS NOT NULL), x AS (SELECT cluster_hash, unnest(regexp_extract_all(lower(top_terms), '[a-zA-ZЀ-ӿ]{4,}')) AS term FROM w),
    c AS (SELECT cluster_hash, term, count(*) AS n FROM x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_hash ORDER BY n DESC, term) AS r FROM c) SELECT cluster_hash, string_agg(term, ' / ' ORDER BY term) AS topic FROM r WHERE r <= 3 GROUP BY 1""")
def topics(t: Store) -> DataFrame:
    """Topic labels of clusters: their three most frequent words."""
    words = t("cluster_summaries", "cluster_hash", "top_terms").select("cluster_hash", F.explode(text.topic_words("top_terms")).alias("term"))
    c = words.groupBy("cluster_hash", "term").agg(F.count(F.lit(1)).alias("n"))
    best = c.withColumn("r", F.row_number().over(Window.partitionBy("cluster_hash").orderBy(F.desc("n"), "term"))).filter("r <= 3")
    return best.groupBy("cluster_hash").agg(F.array_join(F.array_sort(F.collect_list("term")), " / ").alias("topic"))


def topic_count(n: int) -> int:
    return max(2, min(max(10, n // 30), n // 3))


@catalog("m19_kmeans_topics")
def kmeans(t: Store) -> DataFrame:
    """Notes by k-means on unit vectors: k = min(max(10, n / 30), n / 3), seed 42."""
    rows = usable_notes(t, "category").filter(F.col("category").isNull() | ~F.col("category").isin(V.SYNTHETIC)).select("id", "embedding")
    n = rows.count()
    if n < 10:
        return rows.select("id", F.lit(0).alias("topic"))
    return kmeans_rows.fit(rows, topic_count(n), seed=42, rounds=10)


FACT_CATEGORIES = ["milestone", "benchmark", "breakthrough", "architecture-decision", "learned-skill", "research", "project-milestone", "project-planning"]
FACT_SKIP = ["self-reflection", "emotional-reflection", "working-memory", "abstract-topic", "atomic-fact"]


@catalog("m20_facts")
def facts(t: Store) -> DataFrame:
    """Facts with a number, at most five a note, in order, of notes of the categories for facts that are no part yet."""
    return number_facts(t, None)


def number_facts(t: Store, newest: int | None) -> DataFrame:
    """``id, category, pos, fact``; with ``newest`` only of the so many newest notes (by id) outside the skipped categories,
    which is how many one run of the batch looks at."""
    notes = t("nodes", "id", "content", "category").filter(~F.col("category").isin(FACT_SKIP))
    if newest:
        notes = notes.orderBy(F.desc("id")).limit(newest)
    done = t("edges", "source_id", "edge_type").filter("edge_type = 'PART_OF'").select(F.col("source_id").alias("id")).distinct()
    notes = notes.filter(F.col("category").isin(FACT_CATEGORIES)).join(done, "id", "left_anti")
    return notes.select("id", "category", F.posexplode(text.list_column(text.number_facts, F.col("content"))).alias("pos", "fact"))


@catalog("m20_fragments")
def fragments(t: Store) -> DataFrame:
    """Facts with the feeling and story of their note, at most five a note: parts that can stand alone."""
    run = lambda x: text.number_facts(x, text.FRAGMENT_PATTERNS, 70, text.FACT_NOISE | {"also"})
    story = F.trim(F.coalesce("emotional_reflection", F.lit("")))
    n = t("nodes", "id", "content", "category", "emotional_tone", "emotional_reflection").filter(F.col("category").isNull() | ~F.col("category").isin(V.SYNTHETIC))
    feeling = F.trim(F.split(F.when(F.col("emotional_tone") != "", F.col("emotional_tone")).otherwise("neutral"), ",")[0])
    rows = n.select("id", "category", feeling.alias("emotion"), F.when(F.length(story) > 120, F.concat(F.substring(story, 1, 117), F.lit("..."))).otherwise(story).alias("narrative"), F.posexplode(text.list_column(run, F.col("content"))).alias("pos", "fact"))
    return rows.select("id", "pos", "fact", F.concat(F.coalesce("category", F.lit("general")), F.lit(" memory")).alias("context"), F.coalesce("emotion", F.lit("neutral")).alias("emotion"), "narrative")


@catalog("m04_anchors")
def anchors(t: Store) -> DataFrame:
    """Keyword anchors of notes of 80 characters or more: their keys, seven at most."""
    found, _ = lifecycle.keyword_anchors(t("nodes", "id", "content", "category"))
    return found.select(F.col("parent").alias("id"), "content", "tags")


@catalog(
    "m02_summaries",
    """WITH w AS (SELECT id, category AS cluster, unnest(list_distinct(regexp_extract_all(lower(content), '[a-zA-Zа-яА-ЯёЁ0-9_]+'))) AS term FROM nodes),
    a AS (SELECT category AS cluster, unnest(regexp_extract_all(lower(content), '[a-zA-Zа-яА-ЯёЁ0-9_]+')) AS term FROM nodes WHERE category IS NOT NULL), c AS (SELECT cluster, term, count(*) AS c FROM a WHERE length(term) > 1 GROUP BY 1, 2),
    l AS (SELECT cluster, sum(c) AS length FROM c GROUP BY 1), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM l),
    s AS (SELECT cluster, term, round((c / length) * (ln((n + 1) / (df + 1)) + 1), 9) AS weight FROM c JOIN l USING (cluster) JOIN f USING (term) CROSS JOIN n),
    k AS (SELECT cluster, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS r FROM s) WHERE r <= 15),
    v AS (SELECT cluster, id, count(*) AS covered FROM w JOIN k USING (cluster, term) GROUP BY 1, 2), b AS (SELECT cluster, id AS representative, covered FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY covered DESC, id) AS r FROM v) WHERE r = 1)
    SELECT cluster, terms, representative, covered FROM b JOIN (SELECT cluster, string_agg(term, ', ' ORDER BY weight DESC, term) AS terms FROM k GROUP BY 1) USING (cluster)""",
)
def summaries(t: Store) -> DataFrame:
    """Per category the 15 weightiest terms and the note that covers most of them."""
    terms = text_index.cluster_tfidf(t("nodes", "id", "category", "content"), "id", "category", "content", top=15)
    words = t("nodes", "id", "category", "content").select("id", F.col("category").alias("cluster"), F.explode(F.array_distinct(text_index.tokens("content"))).alias("term"))
    cover = words.join(terms, ["cluster", "term"]).groupBy("cluster", "id").agg(F.count(F.lit(1)).alias("n"))
    best = cover.groupBy("cluster").agg(F.max(F.struct("n", (-F.col("id")).alias("i"))).alias("b"))
    listed = terms.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))), lambda x: x["term"]), ", ").alias("terms"))
    return listed.join(best, "cluster").select("cluster", "terms", (-F.col("b.i")).alias("representative"), F.col("b.n").alias("covered"))


