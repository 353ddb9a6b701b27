"""The whole upkeep batch, step by step in its fixed order, on tables that are carried from step to step.

Each step sees the tables after the steps before; changed tables are cut after each, so plans do not pile up. Edges of a
step replace that step's edges of the run before, or are added where they are not there. Notes that the batch makes
(anchors, topics, facts, the metrics snapshot) are known by their tags: one that is wanted again keeps its id and time, one
that is no longer wanted goes with its edges. So running twice is running once; only decay takes its factor again in each
run, and logs get a row per run and moment."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noesis import vocabulary as V
from noesis.functions import text
from noesis.operators import access, edits, graph, joins, lifecycle, signals
from noesis.operators import similarity as sim
from noesis.plans import graphs, maintenance, relational
from noesis.plans.maintenance import OUT, _both_ways
from noesis.plans.registry import Catalog, Store
from noesis.session import cut

catalog = Catalog()
QUERIES, SQL = catalog.QUERIES, catalog.SQL
STALE_DAYS = 90
NEWEST_FOR_FACTS = 50
NEWEST_FOR_RELATIONS = 20

#: Tables that the batch writes beside notes and edges, as they begin.
LOGS = {
    "cluster_summaries": "id long, cluster_hash string, representative_node_id long, cluster_size int, top_terms string, score double, created_at timestamp",
    "contradiction_log": "id long, older_node_id long, newer_node_id long, similarity double, severity double, signals string, type string, status string, created_at timestamp, resolved_at timestamp, notes string",
    "edge_history": "source_id long, target_id long, edge_type string, weight double, conflict_type string, existing_edge_type string, created_at timestamp",
    "emergence_log": "timestamp timestamp, convergence_score double, phi_proxy double, self_ref_precision double, composite_score double, details string",
    "metadata": "key string, value string",
}


class State(Store):
    """The tables of a store with those that the batch has changed in place of the first."""

    def __init__(self, first: Store) -> None:
        super().__init__(first.spark, getattr(first, "base", ""))
        self.first, self.own = first, {}

    def __call__(self, name: str, *columns) -> DataFrame:
        df = self.own.get(name)
        if df is None:
            try:
                df = self.first(name)
            except Exception:
                if name not in LOGS:
                    raise
                df = self.spark.createDataFrame([], LOGS[name])
        return df.select(*columns) if columns else df

    def put(self, name: str, df: DataFrame) -> None:
        self.own[name] = cut(df, name)


def _edges(df: DataFrame, kind: str, weight: Column) -> DataFrame:
    return df.select("source_id", "target_id", F.lit(kind).alias("edge_type"), weight.cast("double").alias("weight"))


def summaries(t: Store) -> DataFrame:
    """``leader, cluster_hash, representative_node_id, cluster_size, top_terms, score`` of thematic clusters of two notes or
    more: 0.6 x share of the 20 weightiest terms that a note has + 0.4 x its rank among similar notes of the cluster."""
    clusters = cut(thematic_clusters(t), "clusters")
    sizes = clusters.groupBy("leader").agg(F.count(F.lit(1)).cast("int").alias("cluster_size"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), "_")).alias("cluster_hash")).filter("cluster_size > 1")
    words = t("nodes", "id", "content").join(clusters, "id").select("leader", "id", F.explode(text.summary_tokens("content")).alias("term"))
    per = cut(words.groupBy("leader", "id", "term").agg(F.count(F.lit(1)).alias("c")), "cluster-terms")
    length = per.groupBy("leader", "id").agg(F.sum("c").alias("len"))
    df = per.groupBy("leader", "term").agg(F.count(F.lit(1)).alias("df"))
    n = clusters.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    weight = (F.col("c") / F.col("len")) * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    scored = per.join(length, ["leader", "id"]).join(df, ["leader", "term"]).join(n, "leader").groupBy("leader", "term").agg(F.round(F.sum(weight), 9).alias("w"))
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("leader").orderBy(F.desc("w"), "term"))).filter("r <= 20")
    count = top.groupBy("leader").agg(F.count(F.lit(1)).alias("k"))
    cover = per.join(top.select("leader", "term"), ["leader", "term"]).groupBy("leader", "id").agg(F.count(F.lit(1)).alias("hits")).join(count, "leader").select("leader", "id", (F.col("hits") / F.col("k")).alias("cover"))
    rank = graph.cluster_rank(clusters, cluster_pairs(t, clusters))
    best = Window.partitionBy("leader")
    both = clusters.join(cover, ["leader", "id"], "left").join(rank, ["leader", "id"])
    score = 0.6 * F.coalesce("cover", F.lit(0.0)) + 0.4 * F.coalesce(F.try_divide("rank", F.max("rank").over(best)), F.lit(0.0))
    both = both.withColumn("score", F.round(score, 9)).withColumn("r", F.row_number().over(best.orderBy(F.desc("score"), "id"))).filter("r = 1")
    listed = top.filter("r <= 15").groupBy("leader").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), ",").alias("top_terms"))
    return both.join(sizes, "leader").join(listed, "leader", "left").select("leader", "cluster_hash", F.col("id").alias("representative_node_id"), "cluster_size", F.coalesce("top_terms", F.lit("")).alias("top_terms"), "score")


def thematic_clusters(t: Store, least: float = 0.75) -> DataFrame:
    notes = maintenance.usable_notes(t)
    return graph.leader_clusters(notes.select("id"), sim.similar_pairs(notes, "id", "embedding", least=least))


def cluster_pairs(t: Store, clusters: DataFrame, least: float = 0.65) -> DataFrame:
    """``leader, a, b, similarity``: similar notes of one cluster."""
    pairs = sim.similar_pairs(maintenance.usable_notes(t).join(clusters.select("id"), "id", "left_semi"), "id", "embedding", least=least)
    side = lambda c: clusters.select(F.col("id").alias(c), "leader")
    return pairs.join(side("a"), "a").join(side("b"), ["b", "leader"]).select("leader", "a", "b", "similarity")


@catalog("m02_cluster_summaries")
def m02s(t: Store) -> DataFrame:
    return summaries(t).select("cluster_hash", "representative_node_id", "cluster_size", "top_terms", F.round("score", 6).alias("score"))


@catalog("g10_cluster_rank")
def g10(t: Store) -> DataFrame:
    """Rank of every note among the similar notes of its thematic cluster."""
    clusters = cut(thematic_clusters(t), "clusters")
    return graph.cluster_rank(clusters, cluster_pairs(t, clusters)).select("leader", "id", F.round("rank", 6).alias("rank"))


def _write_summaries(t: State, now: str) -> dict[str, DataFrame]:
    old, new = t("cluster_summaries"), summaries(t)
    kept = old.join(new.select("cluster_hash"), "cluster_hash", "left_anti").select(*old.columns)
    same = new.join(old.select("cluster_hash", F.col("id").alias("_id"), F.col("created_at").alias("_at")), "cluster_hash", "left")
    known, fresh = same.filter("_id is not null").withColumn("id", F.col("_id")), edits.number_new(same.filter("_id is null"), old, ["cluster_hash"])
    rows = known.unionByName(fresh.select(*known.columns)).withColumn("created_at", F.coalesce("_at", F.lit(now).cast("timestamp")))
    return {"cluster_summaries": kept.unionByName(rows.select(*[F.col(f.name).cast(f.dataType) for f in old.schema]))}


def contradiction_rows(t: Store) -> DataFrame:
    """``older_node_id, newer_node_id, similarity, severity, signals, type``: pairs by time and signals, and identity conflicts
    that are not among them, each unordered pair once."""
    general = maintenance.found_contradictions(t).select(
        F.col("source_id").alias("older_node_id"), F.col("target_id").alias("newer_node_id"), F.round("similarity", 4).alias("similarity"), F.round("severity", 4).alias("severity"), F.array_join("signals", "; ").alias("signals"), F.lit("general").alias("type")
    )
    at = t("nodes", "id", "timestamp")
    pairs = maintenance.identity(t, 0.5).join(at.select(F.col("id").alias("a"), F.col("timestamp").alias("ta")), "a").join(at.select(F.col("id").alias("b"), F.col("timestamp").alias("tb")), "b")
    swap = F.coalesce(F.col("ta") > F.col("tb"), F.lit(False))
    identity = pairs.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("older_node_id"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("newer_node_id"), "similarity",
        F.round(F.col("similarity") * 0.8, 4).alias("severity"), F.lit("identity_conflict").alias("signals"), F.lit("identity_conflict").alias("type"),
    )
    key = lambda df: df.withColumn("_x", F.least("older_node_id", "newer_node_id")).withColumn("_y", F.greatest("older_node_id", "newer_node_id"))
    general = cut(general, "contradictions")
    rest = key(identity).join(key(general).select("_x", "_y").distinct(), ["_x", "_y"], "left_anti").drop("_x", "_y")
    return general.unionByName(rest)


def _write_contradictions(t: State, now: str) -> dict[str, DataFrame]:
    """New pairs go to the log, numbered behind it, and to the edges, both ways and with the severity below zero."""
    log, rows = t("contradiction_log"), contradiction_rows(t)
    seen = log.filter("status is null or status <> 'false_positive'").select("older_node_id", "newer_node_id").distinct()
    fresh = cut(rows.join(seen, ["older_node_id", "newer_node_id"], "left_anti"), "new-contradictions")
    numbered = edits.number_new(fresh, log, ["older_node_id", "newer_node_id"])
    added = numbered.withColumns({"status": F.lit("pending"), "created_at": F.lit(now).cast("timestamp"), "resolved_at": F.lit(None).cast("timestamp"), "notes": F.lit(None).cast("string")})
    pairs = fresh.select(F.col("older_node_id").alias("source_id"), F.col("newer_node_id").alias("target_id"), (-F.col("severity")).alias("weight"))
    new = _both_ways(pairs, "CONTRADICTS", F.col("weight")).withColumn("created_at", F.lit(now).cast("timestamp"))
    return {"contradiction_log": log.unionByName(added.select(*log.columns)), "edges": edits.upsert_edges(t.edges, new)}


def contradiction_edges(t: Store) -> DataFrame:
    """Both directions of all contradictions with their severity below zero."""
    r = contradiction_rows(t)
    return _both_ways(r.select(F.col("older_node_id").alias("source_id"), F.col("newer_node_id").alias("target_id"), "severity"), "CONTRADICTS", -F.col("severity"))


def generalise_edges(t: Store) -> DataFrame:
    found = maintenance.generalises(t)
    back = found.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight")
    return _edges(found, "GENERALIZES", F.col("weight")).unionByName(_edges(back, "INSTANTIATES", F.col("weight")))


def relation_edges(t: Store) -> DataFrame:
    every = maintenance.entity_relations(t).unionByName(maintenance.hub_pairs(t)).distinct()
    return every.select("source_id", "target_id", "edge_type", F.lit(0.5).alias("weight"))


def made_notes(t: Store, wanted: DataFrame, mark: Column, *, now: str, links: DataFrame, kinds: list[str]) -> dict[str, DataFrame]:
    """(notes, edges) with the notes of ``wanted`` (content, category, importance, tags, emotional_intensity) in place of those
    under ``mark``, a condition on notes, and edges ``links`` (tags, note, edge_type, out, back) between a made note, known by
    its tags, and another note: ``out`` from it, ``back`` to it, null for none."""
    nodes, edges = t.nodes, t.edges
    wanted = cut(wanted.dropDuplicates(["tags"]), "wanted")
    old = nodes.filter(mark)
    known = old.groupBy("tags").agg(F.min("id").alias("id"))
    same = wanted.join(known, "tags").select("id", F.col("content").alias("_content"))
    fresh = edits.number_new(wanted.join(known.select("tags"), "tags", "left_anti"), nodes, ["tags"])
    gone = cut(old.select("id").join(same.select("id"), "id", "left_anti"), "gone")
    kept = nodes.join(gone, "id", "left_anti").join(same, "id", "left").withColumn("content", F.coalesce("_content", "content")).select(*nodes.columns)
    rows = fresh.withColumn("timestamp", F.lit(now).cast("timestamp"))
    shaped = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in nodes.schema])
    ids = cut(same.join(known, "id").select("tags", "id").unionByName(rows.select("tags", "id")), "made-ids")
    for side in ("source_id", "target_id"):
        edges = edges.join(gone.select(F.col("id").alias(side)), side, "left_anti")
    l = links.join(ids, "tags")
    there = l.filter("out is not null").select(F.col("id").alias("source_id"), F.col("note").alias("target_id"), "edge_type", F.col("out").cast("double").alias("weight"))
    back = l.filter("back is not null").select(F.col("note").alias("source_id"), F.col("id").alias("target_id"), "edge_type", F.col("back").cast("double").alias("weight"))
    # a made note that stays loses the links it no longer has
    new = cut(there.unionByName(back).distinct().withColumn("created_at", F.lit(now).cast("timestamp")), "made-edges")
    own = ids.select(F.col("id").alias("_made")).distinct()
    stale = F.col("edge_type").isin(kinds)
    ends = own.withColumn("_own", F.lit(True))
    marked = edges.join(ends.select(F.col("_made").alias("source_id"), F.col("_own").alias("_a")), "source_id", "left").join(ends.select(F.col("_made").alias("target_id"), F.col("_own").alias("_b")), "target_id", "left")
    marked = marked.withColumn("_mine", stale & F.coalesce("_a", "_b", F.lit(False)))
    lost = marked.filter("_mine").join(new.select("source_id", "target_id", "edge_type"), ["source_id", "target_id", "edge_type"], "left_anti").select("source_id", "target_id", "edge_type").distinct()
    left = edges.join(lost, ["source_id", "target_id", "edge_type"], "left_anti").select(*t.edges.columns)
    added = edits.insert_edges(left, new)
    return {"nodes": kept.unionByName(shaped), "edges": left.unionByName(added.select(*t.edges.columns))}


def own_notes(t: Store, *columns: str) -> DataFrame:
    """Notes that the batch has not made itself."""
    return t("nodes", *columns).filter(F.col("category").isNull() | ~F.col("category").isin(V.SYNTHETIC))


def own_chains(t: Store) -> DataFrame:
    c = relational.temporal_chains(own_notes(t, "id", "category", "timestamp"))
    return _edges(c, "temporal_chain", F.lit(0.95))


def _anchors(t: State, now: str) -> dict[str, DataFrame]:
    names = t("node_entities", "node_id", "entity_id").distinct().join(t("entities", F.col("id").alias("entity_id"), "name"), "entity_id")
    names = names.groupBy("node_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "name"))), lambda x: x["name"]), 1, 7).alias("names"))
    found, _ = lifecycle.keyword_anchors(own_notes(t, "id", "content", "category"), names)
    found = cut(found.drop("embedding"), "anchors")
    wanted = found.select("content", "category", "importance", "tags", F.lit(5).alias("emotional_intensity"))
    links = found.select("tags", F.col("parent").alias("note"), F.lit("PART_OF").alias("edge_type"), F.lit(1.0).alias("out"), F.lit(None).cast("double").alias("back"))
    mark = (F.col("category") == "keyword-anchor") & F.col("tags").startswith("anchor parent-")
    return made_notes(t, wanted, mark, now=now, links=links, kinds=["PART_OF"])


def topic_members(t: Store, *, least: int = 3, most: int = 50) -> DataFrame:
    """``label, id``: members of the clusters in ``cluster_summaries`` by their consolidation links, up to ``most`` each, under
    the three most frequent words (of four characters or more, among the five most frequent of three or more, first seen first
    on ties) of all of them."""
    heads = t("cluster_summaries", "cluster_hash", "representative_node_id", "cluster_size").filter((F.col("cluster_size") >= least) & F.col("representative_node_id").isNotNull())
    near = joins.adjacency(t("edges", "source_id", "target_id", "weight", "edge_type").filter("edge_type = 'consolidation'")).select(F.col("src").alias("representative_node_id"), F.col("dst").alias("id")).distinct()
    found = heads.join(near, "representative_node_id").select("cluster_hash", "id", "representative_node_id")
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("cluster_hash").orderBy("id"))).filter(F.col("r") <= most).select("cluster_hash", "id")
    members = cut(first.unionByName(heads.select("cluster_hash", F.col("representative_node_id").alias("id"))).distinct(), "topic-members")
    sized = members.groupBy("cluster_hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("cluster_hash")
    members = members.join(sized, "cluster_hash")
    words = t("nodes", "id", "content").join(members, "id").select("cluster_hash", "id", F.posexplode(text.topic_words("content", 3)).alias("pos", "term")).filter(~F.col("term").isin(V.STOPWORDS))
    c = words.groupBy("cluster_hash", "term").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "pos")).alias("seen"))
    total = c.groupBy("cluster_hash").agg(F.sum("n").alias("t")).filter("t >= 5").select("cluster_hash")
    five = c.join(total, "cluster_hash").withColumn("r", F.row_number().over(Window.partitionBy("cluster_hash").orderBy(F.desc("n"), "seen"))).filter("r <= 5")
    three = five.filter(F.length("term") > 3).withColumn("q", F.row_number().over(Window.partitionBy("cluster_hash").orderBy("r"))).filter("q <= 3")
    labels = three.groupBy("cluster_hash").agg(F.array_join(F.array_sort(F.collect_list("term")), " / ").alias("label"))
    return members.join(labels, "cluster_hash").select("label", "id").distinct()


@catalog("m18_topic_members")
def m18m(t: Store) -> DataFrame:
    return topic_members(t)


def _topic_notes(t: State, members: DataFrame, head: str, tag: str, out: float, back: float, now: str, *, least: int) -> dict[str, DataFrame]:
    members = cut(members, "members")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    tags = F.concat(F.lit(f"topic {tag} "), F.col("label"))
    content = F.concat(F.lit(f"ABSTRACT TOPIC ({head}): "), "label", F.lit("\n"), F.col("n").cast("string"), F.lit(" members"))
    wanted = sizes.select(content.alias("content"), F.lit("abstract-topic").alias("category"), F.lit("critical").alias("importance"), tags.alias("tags"), F.lit(3).alias("emotional_intensity"))
    links = members.join(sizes.select("label"), "label").select(tags.alias("tags"), F.col("id").alias("note"), F.lit("BELONGS_TO").alias("edge_type"), F.lit(back).alias("out"), F.lit(out).alias("back"))
    return made_notes(t, wanted, (F.col("category") == "abstract-topic") & F.col("tags").startswith(f"topic {tag} "), now=now, links=links, kinds=["BELONGS_TO"])


def _term_topics(t: State, now: str) -> dict[str, DataFrame]:
    real = t("nodes", "id", "category").filter("category is null or category <> 'abstract-topic'").select("id")
    return _topic_notes(t, topic_members(t).join(real, "id", "left_semi"), "TF-IDF", "terms", 0.5, 0.4, now, least=3)


def _kmeans_topics(t: State, now: str) -> dict[str, DataFrame]:
    """Topics by k-means stand beside those by terms, as each has its own tags."""
    found = maintenance.kmeans(t)
    return _topic_notes(t, found.select(F.concat(F.lit("cluster "), F.col("topic").cast("string")).alias("label"), "id"), "K-means", "kmeans", 0.6, 0.5, now, least=2)


def _facts(t: State, now: str) -> dict[str, DataFrame]:
    """Facts of the newest notes; those of notes done in runs before stay, as their notes are parts by then."""
    found = cut(maintenance.number_facts(t, NEWEST_FOR_FACTS), "facts")
    tags = F.concat(F.lit("fact parent-"), F.col("id").cast("string"), F.lit(" no-"), F.col("pos").cast("string"))
    content = F.concat(F.lit("FACT: "), "fact", F.lit("\nSource category: "), "category")
    wanted = found.select(content.alias("content"), F.lit("atomic-fact").alias("category"), F.lit("normal").alias("importance"), tags.alias("tags"), F.lit(1).alias("emotional_intensity"))
    links = found.select(tags.alias("tags"), F.col("id").alias("note"), F.lit("PART_OF").alias("edge_type"), F.lit(0.8).alias("out"), F.lit(0.8).alias("back"))
    return made_notes(t, wanted, F.lit(False), now=now, links=links, kinds=[])


def relation_rows(t: Store, triples: DataFrame, *, each: int = 3) -> DataFrame:
    """``source_id, target_id, edge_type`` of triples (node_id, head, relation, tail): the first ``each`` notes of the entity at
    either end, by lower-case name, the note itself where an end has none; none where neither end has, and no loops."""
    index = t("node_entities", "node_id", "entity_id").distinct().join(t("entities", F.col("id").alias("entity_id"), F.lower("name").alias("name")), "entity_id").select("name", "node_id").distinct()
    index = index.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("node_id"))).filter(F.col("r") <= each).groupBy("name").agg(F.array_sort(F.collect_list("node_id")).alias("ids"))
    x = triples.select("node_id", F.lower("head").alias("h"), "relation", F.lower("tail").alias("q"))
    x = x.join(index.select(F.col("name").alias("h"), F.col("ids").alias("hs")), "h", "left").join(index.select(F.col("name").alias("q"), F.col("ids").alias("qs")), "q", "left").filter("hs is not null or qs is not null")
    own = F.array("node_id")
    out = x.select("relation", F.explode(F.coalesce("hs", own)).alias("source_id"), F.coalesce("qs", own).alias("qs")).select("source_id", F.explode("qs").alias("target_id"), F.col("relation").alias("edge_type"))
    return out.filter("source_id <> target_id").distinct()


def _extracted(extractor) -> Callable[[State, str], dict[str, DataFrame]]:
    def step(t: State, now: str) -> dict[str, DataFrame]:
        """Relations of the notes since the last run, oldest first and at most twenty; a pair that has an edge of another type
        keeps it, and the find goes to ``edge_history``."""
        from noesis.functions.plugins import related

        mark = t("metadata").filter("key = 'last_sleep_at'").select("value").first()
        new = access.since(t("nodes", "id", "content", "timestamp"), mark[0] if mark else "1900-01-01 00:00:00", NEWEST_FOR_RELATIONS)
        triples = related(new, "id", "content", extractor).select(F.col("id").alias("node_id"), "head", "relation", "tail")
        rows = cut(relation_rows(t, triples), "relations")
        known = t("edges", "source_id", "target_id", F.col("edge_type").alias("existing_edge_type")).groupBy("source_id", "target_id").agg(F.min("existing_edge_type").alias("existing_edge_type"))
        met = rows.join(known, ["source_id", "target_id"], "left")
        fresh = met.filter("existing_edge_type is null").select("source_id", "target_id", "edge_type", F.lit(0.6).alias("weight"), F.lit(now).cast("timestamp").alias("created_at"))
        clash = met.filter("existing_edge_type <> edge_type").select("source_id", "target_id", "edge_type", F.lit(0.6).alias("weight"), F.lit("type_conflict").alias("conflict_type"), "existing_edge_type", F.lit(now).cast("timestamp").alias("created_at"))
        history, key = t("edge_history"), ["source_id", "target_id", "edge_type"]
        clash = clash.join(history.select(*key).distinct(), key, "left_anti")
        return {"edges": t.edges.unionByName(edits.insert_edges(t.edges, fresh).select(*t.edges.columns)), "edge_history": history.unionByName(clash.select(*history.columns))}

    return step


def synonym_edges(t: Store, synonyms: dict[str, str] | None = None) -> DataFrame:
    """Entity edges both ways between notes of an alias and notes of its canonical name."""
    table = synonyms if synonyms is not None else V.SYNONYMS
    pairs = t.spark.createDataFrame([(a, c) for a, c in table.items() if a != c] or [("", "")], "alias string, canonical string")
    names = t("entities", F.col("id").alias("entity_id"), F.lower("name").alias("name"))
    links = t("node_entities", "node_id", "entity_id").filter("node_id is not null").distinct()
    notes = names.join(links, "entity_id").select("name", "node_id").distinct()
    deal = 16  # one side by hash, the other to every part
    left = F.broadcast(pairs).join(notes.withColumnRenamed("name", "alias"), "alias").select("canonical", F.col("node_id").alias("source_id")).distinct().withColumn("part", F.pmod(F.xxhash64("source_id"), F.lit(deal)).cast("int"))
    right = notes.join(F.broadcast(pairs.select(F.col("canonical").alias("name")).distinct()), "name").select(F.col("name").alias("canonical"), F.col("node_id").alias("target_id"), F.explode(F.sequence(F.lit(0), F.lit(deal - 1))).alias("part"))
    met = left.join(right, ["canonical", "part"]).filter("source_id <> target_id").select("source_id", "target_id").distinct()
    return _both_ways(met, "entity", F.lit(0.6)).distinct()


def signal_row(t: Store, *, precision: float | Column | None = None) -> DataFrame:
    """One row: the eight signals by name, their weighted sum and the weakest. ``self_ref_precision`` comes from the last row
    of the emergence log, 0 without one."""
    last = precision
    if last is None:
        try:
            row = t("emergence_log").orderBy(F.desc("timestamp")).limit(1).select("self_ref_precision").first()
            last = float(row[0]) if row and row[0] is not None else 0.0
        except Exception:
            last = 0.0
    edges, nodes = t("edges", "source_id", "target_id", "weight", "edge_type"), t("nodes", "id", "category", "content")
    row = graphs.a22(t).withColumnRenamed("phi", "phi_proxy")
    row = row.crossJoin(signals.hub_reach(edges, nodes).select(F.round("reach", 6).alias("global_workspace")))
    row = row.crossJoin(graphs.g12(t).select(F.col("density").alias("self_model_stability")))
    row = row.crossJoin(relational.a09(t).select(F.coalesce("correlation", F.lit(0.0)).alias("emotional_modulation")))
    row = row.crossJoin(relational.a23(t).withColumnRenamed("richness", "world_model_richness"))
    row = row.crossJoin(signals.reflection(nodes).select(F.round("reflection", 6).alias("metacognition")))
    row = row.crossJoin(graphs.g17(t).withColumnRenamed("continuity", "temporal_continuity"))
    return signals.weighted(row.withColumn("self_ref_precision", last if isinstance(last, Column) else F.lit(float(last))))


_FIRST = f"least({', '.join(V.SIGNAL_WEIGHTS)})"
_WEAKEST = "CASE " + " ".join(f"WHEN {n} = {_FIRST} THEN '{n}'" for n in V.SIGNAL_WEIGHTS) + " END"


@catalog(
    "m21_signals",
    "WITH "
    + ", ".join(f"{name} AS ({body})" for name, body in (
        ("s1", graphs.SQL["a22_cluster_phi"]), ("s3", graphs.SQL["g12_density"]), ("s4", relational.SQL["a09_intensity_degree"]), ("s5", relational.SQL["a23_world_richness"]), ("s7", graphs.SQL["g17_temporal_continuity"])
    ))
    + f""", counted AS (SELECT count(*) AS total FROM nodes WHERE category NOT IN ({', '.join(repr(c) for c in V.NOT_COUNTED)})), hubs AS (SELECT source_id FROM edges GROUP BY 1 ORDER BY count(*) DESC, source_id LIMIT 5),
    near AS (SELECT * FROM (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY target_id) AS r FROM edges WHERE source_id IN (SELECT source_id FROM hubs)) WHERE r <= 2000),
    far AS (SELECT * FROM (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY target_id) AS r FROM edges WHERE source_id IN (SELECT target_id FROM near WHERE r <= 100)) WHERE r <= 200),
    reached AS (SELECT count(*) AS n FROM (SELECT source_id AS id FROM hubs UNION SELECT target_id FROM near UNION SELECT target_id FROM far)),
    s2 AS (SELECT round(least(1.0, n / total), 6) AS reach FROM reached, counted),
    s6 AS (SELECT round(least(1.0, greatest(count(*) FILTER (category IN ({', '.join(repr(c) for c in V.RECALL_META)})), count(*) FILTER ({' OR '.join(f"content ILIKE '%{w}%'" if w.isascii() else f"contains(content, '{w}')" for w in V.META_WORDS)})) / (SELECT total FROM counted)), 6) AS reflection FROM nodes),
    v AS (SELECT phi AS phi_proxy, reach AS global_workspace, density AS self_model_stability, coalesce(correlation, 0) AS emotional_modulation, richness AS world_model_richness, reflection AS metacognition, continuity AS temporal_continuity, 0.0 AS self_ref_precision FROM s1, s2, s3, s4, s5, s6, s7)
    SELECT round(phi_proxy, 6) AS phi_proxy, round(global_workspace, 6) AS global_workspace, round(metacognition, 6) AS metacognition, round({' + '.join(f'{n} * {w}' for n, w in V.SIGNAL_WEIGHTS.items())}, 4) AS composite, {_WEAKEST} AS bottleneck FROM v""",
)
def m21(t: Store) -> DataFrame:
    """The eight signals; a store without an emergence log has no self-reference yet, so that is the weakest unless one before
    it is 0 too."""
    return signal_row(t, precision=0.0).select("phi_proxy", "global_workspace", "metacognition", F.round("composite", 4).alias("composite"), "bottleneck")


def emergence_row(t: Store, queries: DataFrame | None = None, community: DataFrame | None = None) -> DataFrame:
    """One row: convergence, phi of the communities, self-reference of ``queries`` (query_id, embedding; none scores 0) and
    their sum."""
    edges, nodes = t("edges", "source_id", "target_id", "weight", "edge_type"), t("nodes", "id", "category", "embedding")
    community = graph.largest_communities(edges) if community is None else community
    row = signals.convergence(edges, nodes).crossJoin(signals.community_phi(edges, community, nodes))
    if queries is None:
        row = row.withColumn("precision", F.lit(0.0)).withColumn("queries", F.lit(0).cast("long"))
    else:
        row = row.crossJoin(signals.self_precision(queries, nodes))
    return row.withColumn("composite", signals.emergence(F.col("convergence"), F.col("phi"), F.col("precision")))


def _emergence(queries: DataFrame | None) -> Callable[[State, str], dict[str, DataFrame]]:
    def step(t: State, now: str) -> dict[str, DataFrame]:
        row = emergence_row(t, queries)
        details = F.to_json(F.struct("seeds", "crossing", "isolated", F.round("mean_weight", 4).alias("mean_weight"), "queries"))
        new = row.select(F.lit(now).cast("timestamp").alias("timestamp"), F.col("convergence").alias("convergence_score"), F.col("phi").alias("phi_proxy"), F.col("precision").alias("self_ref_precision"), F.col("composite").alias("composite_score"), details.alias("details"))
        log = t("emergence_log")
        return {"emergence_log": log.filter(F.col("timestamp") != F.lit(now).cast("timestamp")).unionByName(new.select(*log.columns))}

    return step


def _snapshot_note(t: State, now: str) -> dict[str, DataFrame]:
    row = signal_row(t)
    lines = [F.concat(F.lit(f"- {n}: "), F.format_number(n, 4)) for n in ["composite", *V.SIGNAL_WEIGHTS]]
    content = F.concat_ws("\n", F.lit(f"METRICS SNAPSHOT {now[:10]} (auto)"), F.lit(""), *lines, F.concat(F.lit("Bottleneck: "), "bottleneck"))
    wanted = row.select(content.alias("content"), F.lit("metrics-snapshot").alias("category"), F.lit("normal").alias("importance"), F.lit(f"metrics-snapshot day-{now[:10]} auto-sleep").alias("tags"), F.lit(6).alias("emotional_intensity"))
    none = t.spark.createDataFrame([], "tags string, note long, edge_type string, out double, back double")
    return made_notes(t, wanted, F.col("tags") == f"metrics-snapshot day-{now[:10]} auto-sleep", now=now, links=none, kinds=[])


def _prospective(t: State, now: str) -> dict[str, DataFrame]:
    return {"nodes": edits.prospective(t.nodes, now[:10]).select(*t.nodes.columns)}


def _boosted(t: State, now: str) -> dict[str, DataFrame]:
    return {"nodes": edits.boosted(t.nodes, access.protected_categories(t("nodes", "category", "importance"))).select(*t.nodes.columns)}


def _demoted(t: State, now: str) -> dict[str, DataFrame]:
    older = t("edges", "target_id", "edge_type", "created_at").filter((F.col("edge_type") == "SUPERSEDES") & (F.col("created_at") == F.lit(now).cast("timestamp"))).select(F.col("target_id").alias("id")).distinct().withColumn("_old", F.lit(True))
    n = t.nodes.join(older, "id", "left")
    return {"nodes": n.withColumn("importance", F.when(F.col("_old") & (F.col("importance") == "normal"), "low").otherwise(F.col("importance"))).select(*t.nodes.columns)}


def _decayed(t: State, now: str) -> dict[str, DataFrame]:
    safe = access.protected_categories(t("nodes", "category", "importance"))
    ids = t("nodes", "id", "category").withColumn("category", F.lower("category")).join(safe, "category", "left_semi").select("id")
    cutoff = (datetime.fromisoformat(now) - timedelta(days=STALE_DAYS)).isoformat(sep=" ")
    return {"edges": edits.decayed(t.edges, ids, access.stale("created_at", "weight", cutoff)).select(*t.edges.columns)}


def _marked(t: State, now: str) -> dict[str, DataFrame]:
    m = t("metadata")
    row = t.spark.createDataFrame([("last_sleep_at", now)], m.schema)
    return {"metadata": m.filter("key <> 'last_sleep_at'").unionByName(row)}


def _metrics(t: State, now: str) -> DataFrame:
    """PageRank and community of every note with an edge; reported, not kept."""
    e = t("edges", "source_id", "target_id", "weight", "edge_type")
    return graph.pagerank(e).join(graph.largest_communities(e), "node_id", "left")


def _links(step: Callable[[Store], DataFrame], kinds: list[str] | None = None) -> Callable[[State, str], dict[str, DataFrame]]:
    """A step of new edges that replace those of ``kinds``, or are added where their triple is not there."""

    def run(t: State, now: str) -> dict[str, DataFrame]:
        edges = t.edges
        new = step(t).select(*OUT).withColumn("created_at", F.lit(now).cast("timestamp"))
        if kinds:
            # an edge that is made again keeps the moment of the first time
            was = edges.filter(F.col("edge_type").isin(kinds)).groupBy("source_id", "target_id", "edge_type").agg(F.min("created_at").alias("_at"))
            once = new.groupBy("source_id", "target_id", "edge_type").agg(F.max("weight").alias("weight"), F.min("created_at").alias("created_at"))
            new = once.join(was, ["source_id", "target_id", "edge_type"], "left").withColumn("created_at", F.coalesce("_at", "created_at"))
            return {"edges": edits.replace_edges(edges, new.select(*edges.columns), kinds)}
        return {"edges": edges.unionByName(edits.insert_edges(edges, new).select(*edges.columns))}

    return run


def _report(step: Callable[[State, str], DataFrame]) -> Callable[[State, str], dict[str, DataFrame]]:
    return lambda t, now: {"": step(t, now)}


def steps(*, extractor=None, queries: DataFrame | None = None) -> list[tuple[str, Callable[[State, str], dict[str, DataFrame]]]]:
    """Name and step, in their fixed order. Steps give the tables they change, or under no name the rows they report.
    ``extractor`` finds relations in new notes, ``queries`` are the vectors for self-reference."""
    plan = [
        ("consolidation", _links(maintenance.thematic, ["consolidation"])),
        ("chains", _links(own_chains, ["temporal_chain"])),
        ("summaries", _write_summaries),
        ("contradictions", _write_contradictions),
        ("anchors", _anchors),
        ("resonance", _links(maintenance.resonance, ["EMOTIONAL_RESONANCE"])),
        ("generalises", _links(generalise_edges, ["GENERALIZES", "INSTANTIATES"])),
        ("metrics", _report(_metrics)),
        ("relations", _links(relation_edges)),
        ("extraction", _extracted(extractor)),
        ("orphans", _report(lambda t, now: joins.orphan_notes(t("nodes", "id", "category"), t("edges", "source_id", "target_id")))),
        ("prospective", _prospective),
        ("decay", _decayed),
        ("boost", _boosted),
        ("emergence", _emergence(queries)),
        ("duplicates", _report(lambda t, now: relational.duplicates(t))),
        ("supersedes", _links(lambda t: _edges(maintenance.supersedes(t), "SUPERSEDES", F.col("weight")))),
        ("demote", _demoted),
        ("synonyms", _links(synonym_edges)),
        ("topics", _term_topics),
        ("kmeans", _kmeans_topics),
        ("facts", _facts),
        ("snapshot", _snapshot_note),
        ("mark", _marked),
    ]
    return [p for p in plan if p[0] != "extraction" or extractor is not None]


def run(t: Store, *, now: str, dry_run: bool = True, only: list[str] | None = None, snapshots: str | None = None, extractor=None, queries: DataFrame | None = None) -> tuple[dict[str, int], State]:
    """Rows that each step adds, changes or reports, and the tables after all of them. A dry run counts each step on the tables
    as they are and changes none. ``snapshots`` is a folder for a copy of the tables before. A step that fails is counted as
    -1 and changes nothing; the others go on."""
    state, counts = State(t), {}
    if snapshots and not dry_run:
        from noesis.sources.exchange import snapshot

        counts["copies"] = len(snapshot(t.spark, t.base, snapshots))
    for name, step in steps(extractor=extractor, queries=queries):
        if only and name not in only:
            continue
        try:
            out = step(state, now)
            if "" in out:
                counts[name] = out[""].count()
                continue
            new = {table: cut(df, table) for table, df in out.items()}
            counts[name] = sum(_changed(df, state(table)) for table, df in new.items())
        except Exception as e:  # noqa: BLE001
            state.errors = {**getattr(state, "errors", {}), name: repr(e)}
            counts[name] = -1
            continue
        if not dry_run:
            state.own.update(new)
    return counts, state


def _changed(new: DataFrame, old: DataFrame) -> int:
    plain = [f.name for f in new.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType))]
    return new.select(*plain).exceptAll(old.select(*plain)).count()


@catalog(
    "j20_synonym_links",
    """WITH s AS (SELECT min(lower(name)) AS alias, max(lower(name)) AS canonical FROM entities JOIN node_entities ON entity_id = id), l AS (SELECT DISTINCT node_id, lower(name) AS name FROM node_entities JOIN entities e ON e.id = entity_id),
    p AS (SELECT DISTINCT x.node_id AS source_id, y.node_id AS target_id FROM s JOIN l x ON x.name = alias JOIN l y ON y.name = canonical WHERE x.node_id <> y.node_id) SELECT source_id, target_id, 'entity' AS edge_type, 0.6::DOUBLE AS weight FROM p UNION SELECT target_id, source_id, 'entity', 0.6::DOUBLE FROM p""",
)
def j20(t: Store) -> DataFrame:
    """Links between the notes of two names, here the first and the last of the linked ones, taken for synonyms."""
    names = t("entities", F.col("id").alias("entity_id"), F.lower("name").alias("name")).join(t("node_entities", "entity_id"), "entity_id").agg(F.min("name"), F.max("name")).first()
    return synonym_edges(t, {names[0]: names[1]} if names[0] else {})
