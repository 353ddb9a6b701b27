"""The life of a note: insert, update with versions, history and restore, touches, tags, parts, intentions, policies, entities.

Every function gives new frames; nothing is written in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noesis import vocabulary as V
from noesis.functions import text, times, vectors
from noesis.operators import edits, joins

VERSIONED = ["content", "category", "importance", "emotional_tone", "emotional_intensity", "emotional_reflection"]
POLICY = "category string, policy_type string, description string, created_at timestamp, created_by string"


def new_notes(batch: DataFrame, taken: DataFrame, *, now: str, emotions: bool = False, order: list[str] | None = None) -> DataFrame:
    """Notes of a batch as the store keeps them: ids behind the largest taken, the moment ``now``, defaults for what is
    missing, times read from the content, emotional fields zeroed unless ``emotions``."""
    have = set(batch.columns)
    kinds = {"category": ("string", "general"), "importance": ("string", "normal"), "emotional_tone": ("string", ""), "emotional_intensity": ("int", 5), "emotional_reflection": ("string", ""), "tags": ("string", ""), "access_count": ("int", 0)}
    n = batch
    for name, (kind, default) in kinds.items():
        own = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        n = n.withColumn(name, F.coalesce(own, F.lit(default)))
    if not emotions:
        n = n.withColumn("emotional_tone", F.lit("")).withColumn("emotional_intensity", F.lit(0)).withColumn("emotional_reflection", F.lit(""))
    if "embedding" not in have:
        n = n.withColumn("embedding", F.lit(None).cast("array<float>"))
    n = n.withColumn("importance", F.when(F.lower(F.trim("importance")).isin(V.IMPORTANCE), F.lower(F.trim("importance"))).otherwise("normal"))
    n = edits.number_new(n.drop("id"), taken, order or ["content", "category"])
    n = n.withColumn("timestamp", F.lit(now).cast("timestamp")).withColumn("last_accessed", F.lit(None).cast("timestamp"))
    timed = times.event_times(n, "id", "content", now)
    return n.drop("temporal_expressions", "t_event_start", "t_event_end").join(timed, "id", "left")


def updated(nodes: DataFrame, versions: DataFrame, changes: DataFrame, *, now: str, keep: int = 5) -> tuple[DataFrame, DataFrame]:
    """(notes, versions) after ``changes`` (id and any of the note's columns; null leaves a value as it is). The state before
    becomes a version, the note's time becomes ``now``, and ``keep`` versions of a note stay."""
    fields = [c for c in changes.columns if c != "id" and c in nodes.columns]
    once = changes.groupBy("id").agg(*[F.max(c).alias(f"_{c}") for c in fields]) if fields else changes.select("id").distinct()
    n = nodes.join(once.withColumn("_hit", F.lit(True)), "id", "left")
    saved = save_versions(versions, nodes.join(once.select("id"), "id", "left_semi"), now=now, keep=keep)
    for c in fields:
        n = n.withColumn(c, F.coalesce(f"_{c}", c))
    n = n.withColumn("timestamp", F.when(F.col("_hit"), F.lit(now).cast("timestamp")).otherwise(F.col("timestamp")))
    return n.select(*nodes.columns), saved


def save_versions(versions: DataFrame, notes: DataFrame, *, now: str, keep: int = 5) -> DataFrame:
    """Versions with one more for every note of ``notes``, numbered behind its last; the newest ``keep`` of a note stay."""
    top = last_version(versions)
    new = notes.select(F.col("id").alias("note_id"), *VERSIONED).join(top, "note_id", "left")
    new = new.select("note_id", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version_number"), *VERSIONED, F.lit(now).cast("timestamp").alias("created_at"))
    return edits.latest_versions(versions.select(*new.columns).unionByName(new), keep)


def last_version(versions: DataFrame) -> DataFrame:
    """``note_id, last``: the largest version number of each note."""
    return versions.groupBy("note_id").agg(F.max("version_number").alias("last"))


def history(versions: DataFrame, ids: DataFrame, most: int = 5) -> DataFrame:
    """The versions of some notes (id), newest first, at most ``most`` each."""
    return edits.latest_versions(versions.join(ids.select(F.col("id").alias("note_id")).distinct(), "note_id", "left_semi"), most).orderBy("note_id", F.desc("version_number"))


def restored(nodes: DataFrame, versions: DataFrame, wanted: DataFrame, *, now: str, keep: int = 5) -> tuple[DataFrame, DataFrame]:
    """(notes, versions) after notes go back to a version (note_id, version_number); the state before is saved first. A
    version that is not there changes nothing."""
    chosen = versions.join(wanted.select("note_id", "version_number").distinct(), ["note_id", "version_number"], "left_semi")
    return updated(nodes, versions, chosen.select(F.col("note_id").alias("id"), *VERSIONED), now=now, keep=keep)


def entity_ids(entities: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, ids) for found names (name, entity_type): a name, normalised, and type that is there keeps its row, others
    get one, numbered behind the last. ``ids`` has name, entity_type, entity_id, one row per name as found."""
    kind = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("concept"))
    own = entities.select("id", text.normal_name("name").alias("_n"), kind("entity_type").alias("_t")).groupBy("_n", "_t").agg(F.min("id").alias("id"))
    asked = found.select("name", "entity_type", text.normal_name("name").alias("_n"), kind("entity_type").alias("_t")).filter("_n is not null and _n <> ''").distinct()
    fresh = asked.join(own, ["_n", "_t"], "left_anti").select(F.col("_n").alias("name"), F.col("_t").alias("entity_type")).distinct()
    fresh = edits.number_new(fresh, entities, ["name", "entity_type"])
    every = entities.select("id", "name", "entity_type").unionByName(fresh.select("id", "name", "entity_type"))
    known = own.unionByName(fresh.select(F.col("name").alias("_n"), F.col("entity_type").alias("_t"), "id"))
    return every, asked.join(known, ["_n", "_t"]).select("name", "entity_type", F.col("id").alias("entity_id"))


def linked(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links (node_id, entity_id) with new ones, each pair once."""
    return links.select("node_id", "entity_id").unionByName(new.select("node_id", "entity_id")).distinct()


def policies_added(policies: DataFrame, new: DataFrame, *, now: str, by: str = "user") -> DataFrame:
    """Policies (category, ...) with those of ``new`` (category, description); categories are trimmed, lower-case and unique,
    the first stays."""
    add = new.select(F.lower(F.trim("category")).alias("category"), F.lit("protect").alias("policy_type"), F.col("description").alias("description"), F.lit(now).cast("timestamp").alias("created_at"), F.lit(by).alias("created_by"))
    fresh = add.filter("category <> ''").dropDuplicates(["category"]).join(policies.select("category"), "category", "left_anti")
    return policies.unionByName(fresh.select(*policies.columns))


def policies_removed(policies: DataFrame, gone: DataFrame) -> DataFrame:
    return policies.join(gone.select(F.lower(F.trim("category")).alias("category")).distinct(), "category", "left_anti").select(*policies.columns)


def intentions(batch: DataFrame) -> DataFrame:
    """Notes of intentions (content, due: yyyy-MM-dd or null): category prospective, tags pending and due."""
    tags = F.concat(F.lit("prospective pending"), F.when(F.col("due").isNotNull(), F.concat(F.lit(" due:"), F.col("due").cast("string"))).otherwise(""))
    return batch.select("content", F.lit("prospective").alias("category"), F.lit("critical").alias("importance"), tags.alias("tags"))


def intentions_completed(nodes: DataFrame, done: DataFrame) -> DataFrame:
    """Notes where the intentions of ``done`` (id, note) have done for pending in their tags, and the note behind their
    content."""
    d = done.groupBy("id").agg(F.min("note").alias("_note")).withColumn("_done", F.lit(True))
    mine = F.coalesce(F.col("_done"), F.lit(False)) & (F.col("category") == "prospective")
    n = nodes.join(d, "id", "left")
    n = n.withColumn("tags", F.when(mine, F.regexp_replace("tags", r"\bpending\b", "done")).otherwise(F.col("tags")))
    n = n.withColumn("content", F.when(mine & F.col("_note").isNotNull(), F.concat("content", F.lit("\n\nCompleted: "), "_note")).otherwise(F.col("content")))
    return n.select(*nodes.columns)


def journal(nodes: DataFrame, last: int = 3, chars: int = 150) -> DataFrame:
    """The latest notes of the working memory, newest first: the first whole, the others cut to ``chars``."""
    newest = nodes.filter("category = 'working-memory'").orderBy(F.desc("timestamp"), F.desc("id")).limit(last)
    w = Window.orderBy(F.desc("timestamp"), F.desc("id"))  # at most ``last`` rows
    return newest.withColumn("place", F.row_number().over(w)).select("place", "id", "timestamp", F.when(F.col("place") == 1, F.col("content")).otherwise(F.substring("content", 1, chars)).alias("content"))


def keyword_anchors(notes: DataFrame, entities: DataFrame | None = None, *, encode=None, weight: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(anchors, links): of every note of 80 characters or more and no skipped category the note of its keys and its PART_OF
    link. ``entities`` (node_id, names) come first among the keys; ``encode`` makes a vector column from the text, which is
    normalised."""
    n = notes.select("id", "content", "category").filter((F.length("content") >= 80) & ~F.coalesce("category", F.lit("")).isin(V.ANCHOR_SKIP))
    if entities is not None:
        n = n.join(entities.select(F.col("node_id").alias("id"), "names"), "id", "left")
    names = F.coalesce("names", F.array().cast("array<string>")) if entities is not None else F.array().cast("array<string>")
    found = text.list_column(text.keyword_keys, F.col("content"))
    keys = F.slice(F.array_distinct(F.concat(F.filter(names, lambda x: F.length(x) > 2), found)), 1, 7)
    a = n.withColumn("_keys", keys).filter(F.size("_keys") > 0)
    said = F.substring(F.concat(F.lit("KEY: "), F.array_join("_keys", " | ")), 1, 300)
    out = a.select(F.col("id").alias("parent"), said.alias("content"), F.lit("keyword-anchor").alias("category"), F.lit("low").alias("importance"), F.concat(F.lit("anchor parent-"), F.col("id").cast("string"), F.lit(" cat-"), F.coalesce("category", F.lit(""))).alias("tags"))
    vector = vectors.unit(encode(F.col("content"))).cast("array<float>") if encode else F.lit(None).cast("array<float>")
    return out.withColumn("embedding", vector), out.select("parent", F.lit("PART_OF").alias("edge_type"), F.lit(weight).alias("weight"))


def chunks(notes: DataFrame, *, size: int = 400, overlap: int = 200, circular: bool = False, parents: bool = True, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(chunk notes, links between them) of every note that makes ``least`` chunks or more. Links name chunks by (parent,
    chunk_no): with ``parents`` PART_OF .9 both ways, else NEXT_CHUNK .85 from each to the next."""
    c = notes.select(F.col("id").alias("parent"), text.chunk_column("content", size, overlap, circular).alias("parts")).filter(F.size("parts") >= least)
    out = c.select("parent", F.posexplode("parts").alias("chunk_no", "content")).withColumns({"category": F.lit("lc-chunk"), "importance": F.lit("low")})
    if parents:
        return out, out.select("parent", "chunk_no", F.lit("PART_OF").alias("edge_type"), F.lit(0.9).alias("weight"))
    size_of = out.groupBy("parent").agg(F.max("chunk_no").alias("last"))
    follow = out.join(size_of, "parent").filter(F.col("chunk_no") < F.col("last"))
    return out, follow.select("parent", "chunk_no", F.lit("NEXT_CHUNK").alias("edge_type"), F.lit(0.85).alias("weight"))


def mini_consolidation(new: DataFrame, store: DataFrame, *, near: int = 16, least: float = 0.75, true_cosine: bool = False) -> DataFrame:
    """``source_id, target_id, edge_type, weight``: links of new notes (id, embedding) to their ``near`` nearest where
    (1 + cosine) / 2, or with ``true_cosine`` the cosine, is at least ``least``."""
    from noesis.operators.ranking import nearest

    found = nearest(new.select(F.col("id").alias("query_id"), "embedding"), store.select("id", "embedding"), k=near + 1, least=-1.0).filter("query_id <> node_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    found = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= near)
    s = F.col("score") if true_cosine else shifted_cosine(F.col("score"))
    return found.withColumn("weight", s).filter(F.col("weight") >= least).select(F.col("query_id").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("consolidation").alias("edge_type"), "weight")


def shifted_cosine(cosine: Column) -> Column:
    """A cosine distance read as a squared length: 1 - (1 - cosine) / 2."""
    return (1.0 + cosine) / 2.0


def tags(notes: DataFrame, links: DataFrame, entities: DataFrame, *, most: int = 6) -> DataFrame:
    """``id, tags``: category (unless general), critical, up to three entities (smallest ids), then words by frequency x
    ln((n + 1) / (df + 1)), up to ``most``."""
    weighed = term_weights(notes)
    w = Window.partitionBy("id").orderBy(F.desc("weight"), "term")
    words = weighed.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("words"))
    named = links.select("node_id", "entity_id").distinct().join(entities.select(F.col("id").alias("entity_id"), F.lower(F.replace("name", F.lit(" "), F.lit("-"))).alias("tag")), "entity_id").filter(F.length("tag") > 2)
    e = Window.partitionBy("node_id").orderBy("entity_id")
    three = named.withColumn("r", F.row_number().over(e)).filter("r <= 3").groupBy(F.col("node_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]).alias("named"))
    n = notes.select("id", "category", "importance").join(three, "id", "left").join(words, "id", "left")
    none = F.array().cast("array<string>")
    head = F.array_compact(F.array(F.when((F.col("category") != "general") & (F.col("category") != ""), F.col("category")), F.when(F.col("importance") == "critical", "critical")))
    head = F.array_distinct(F.concat(head, F.coalesce("named", none)))
    n = n.withColumn("_head", head)
    fill = F.slice(F.coalesce("words", none), F.lit(1), F.greatest(F.lit(0), most - F.size("_head")))
    fill = F.filter(fill, lambda x: ~F.exists("_head", lambda h: (h == x) | (F.replace(h, F.lit("-"), F.lit("")) == x)))
    return n.select("id", F.array_join(F.slice(F.array_distinct(F.concat("_head", fill)), 1, most), " ").alias("tags"))


def term_weights(notes: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """``id, term, weight``: frequency x ln((n + 1) / (df + 1)) of words of three characters or more without stopwords."""
    rows = notes.select(F.col(key).alias("id"), F.explode(text.tokens(content)).alias("term")).filter((F.length("term") > 2) & ~F.col("term").isin(V.STOPWORDS))
    per = rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("f"))
    df = per.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = notes.agg(F.count(F.lit(1)).alias("n"))
    return per.join(df, "term").crossJoin(F.broadcast(n)).select("id", "term", F.round(F.col("f") * F.log((F.col("n") + 1) / (F.col("df") + 1)), 9).alias("weight"))


def missing(nodes: DataFrame, what: str, *, dim: int = 128, links: DataFrame | None = None) -> DataFrame:
    """The notes that a backfill of ``what`` (times, vectors, tags, entities) has to do."""
    if what == "times":
        return nodes.filter("t_event_start is null and temporal_expressions is null")
    if what == "vectors":
        return nodes.filter("embedding is null" + f" or size(embedding) <> {dim}")
    if what == "tags":
        return nodes.filter("tags is null or trim(tags) = ''")
    return joins.without_any(nodes, links.select(F.col("node_id").alias("id")).distinct(), ["id"])


def backfilled(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """Notes with the non-null ``values`` (id and columns of notes) in place of theirs."""
    fields = [c for c in values.columns if c != "id"]
    v = values.select("id", *[F.col(c).alias(f"_{c}") for c in fields])
    n = nodes.join(v, "id", "left")
    for c in fields:
        n = n.withColumn(c, F.coalesce(f"_{c}", c))
    return n.select(*nodes.columns)


def co_mention_edges(links: DataFrame, new: DataFrame, *, weight: float = 0.6) -> DataFrame:
    """``source_id, target_id, edge_type, weight``: entity edges both ways between new notes (node_id, entity_id) and all notes
    that share an entity with them. The side of all notes is dealt, so a well-known entity is no single task."""
    deal = 16
    mine = new.select("node_id", "entity_id").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    every = links.select("entity_id", F.col("node_id").alias("other")).distinct().withColumn("part", F.pmod(F.xxhash64("other"), F.lit(deal)).cast("int"))
    met = mine.join(every, ["entity_id", "part"]).filter("node_id <> other").select("node_id", "other").distinct()
    there = met.select(F.col("node_id").alias("source_id"), F.col("other").alias("target_id"))
    both = there.unionByName(there.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))).distinct()
    return both.select("source_id", "target_id", F.lit("entity").alias("edge_type"), F.lit(weight).alias("weight"))
