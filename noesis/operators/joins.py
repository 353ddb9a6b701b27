"""Joins between notes, entities and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjacency(edges: DataFrame) -> DataFrame:
    """``src, dst, weight, edge_type``: every edge and its reverse, as a multiset; links stored both ways count twice."""
    out = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight", "edge_type")
    back = edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), "weight", "edge_type")
    return out.unionByName(back)


def current_edges(edges: DataFrame) -> DataFrame:
    """One row per (source, target, type): the largest weight, the earliest creation."""
    return edges.groupBy("source_id", "target_id", "edge_type").agg(F.max("weight").alias("weight"), F.min("created_at").alias("created_at"))


def neighbours(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """Distinct neighbours of each queried note (``id``), both directions."""
    return adjacency(edges).join(queries.select(F.col("id").alias("src")), "src", "left_semi").distinct()


def co_mentions(links: DataFrame, *, most: int = 50) -> DataFrame:
    """``node_a, node_b, shared``: pairs of notes that share an entity, smaller id first. Entities with more than ``most``
    notes would make pairs with the square of their notes; their links are whole in ``hub_members``, one row per member,
    and two notes share such an entity when both have a row."""
    once = links.select("node_id", "entity_id").distinct()
    sizes = once.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("n") <= most)).select("entity_id")
    kept = once.join(sizes, "entity_id")
    pairs = kept.select("entity_id", F.col("node_id").alias("node_a")).join(kept.select("entity_id", F.col("node_id").alias("node_b")), "entity_id").filter("node_a < node_b")
    return pairs.groupBy("node_a", "node_b").agg(F.count(F.lit(1)).alias("shared"))


def hub_members(links: DataFrame, *, least: int = 50) -> DataFrame:
    """``entity_id, node_id`` of entities with more than ``least`` notes: their co-mentions in linear form."""
    once = links.select("node_id", "entity_id").distinct()
    hubs = hub_entities(links, least=least).select("entity_id")
    return once.join(hubs, "entity_id", "left_semi").select("entity_id", "node_id")


def hub_entities(links: DataFrame, *, least: int = 50) -> DataFrame:
    return links.select("node_id", "entity_id").distinct().groupBy("entity_id").agg(F.count(F.lit(1)).alias("notes")).filter(F.col("notes") > least)


def tag_resonance(notes: DataFrame, tags: Column, *, shared: int = 2, top: int = 5) -> DataFrame:
    """``node_a, node_b, weight``: notes with at least ``shared`` tags in common, Jaccard weight, at most ``top`` per note
    (larger weight, then larger id), pair once.

    Notes with the same set of tags are one class; classes meet on pairs of tags, so the work follows the number of tag
    sets in use, and a class ranks its best partners once for all its members: no list of notes per tag is built."""
    own = notes.select("id", F.array_sort(F.array_distinct(tags)).alias("tags")).filter(F.size("tags") >= shared)
    size = F.count(F.lit(1)).alias("members")
    classes = own.groupBy("tags").agg(size)
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy("tags").orderBy(F.desc("id")))).filter(F.col("r") <= top + 1)
    heads = ranked.groupBy("tags").agg(F.collect_list("id").alias("heads"))
    couple = F.explode(F.flatten(F.transform("tags", lambda x: F.transform(F.filter("tags", lambda y: y > x), lambda y: F.concat_ws("\x1f", x, y)))))
    keyed = classes.select("tags", couple.alias("couple")) if shared == 2 else classes.select("tags", F.explode("tags").alias("couple"))
    met = keyed.select(F.col("tags").alias("ta"), "couple").join(keyed.select(F.col("tags").alias("tb"), "couple"), "couple").select("ta", "tb").distinct()
    k = F.size(F.array_intersect("ta", "tb"))
    met = met.withColumn("k", k).filter(F.col("k") >= shared).withColumn("weight", F.col("k") / (F.size("ta") + F.size("tb") - F.col("k")))
    offers = met.join(heads.withColumnRenamed("tags", "tb"), "tb").select("ta", "weight", F.explode("heads").alias("b"))
    order = [F.desc("weight"), F.desc("b")]
    offers = offers.withColumn("r", F.row_number().over(Window.partitionBy("ta").orderBy(*order))).filter(F.col("r") <= top + 1).drop("r")
    mine = own.select(F.col("id").alias("a"), F.col("tags").alias("ta")).join(offers, "ta").filter("a <> b")
    best = mine.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(*order))).filter(F.col("r") <= top)
    return best.select(F.least("a", "b").alias("node_a"), F.greatest("a", "b").alias("node_b"), "weight").distinct()


def merge_candidates(entities: DataFrame) -> DataFrame:
    """Entities of one lower-case name under several rows: ids and types in order."""
    g = entities.filter("name is not null").groupBy(F.lower(F.trim("name")).alias("name"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).filter("n > 1")


def without_any(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def orphan_notes(nodes: DataFrame, edges: DataFrame, most: int = 1) -> DataFrame:
    """Notes with at most ``most`` edge ends: degrees are summed before they meet the notes."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id", "category").join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).filter(F.col("degree") <= most)


def nearest_in_time(notes: DataFrame, at: str = "timestamp", k: int = 6) -> DataFrame:
    """``a, b, gap_s, relation``: for each note its k nearest in time (the smaller id on ties). Only the k before and the k
    behind a note in time order can be among them, so two positional windows replace the search. The order is cut into
    ranges by a coarse time bucket; a note's candidates come from its bucket and the k edges of its neighbours, found by
    joining buckets that are non-empty neighbours."""
    rows = notes.filter(F.col(at).isNotNull()).select("id", F.unix_micros(F.col(at)).alias("t"))
    numbered = positions(rows, ["t", "id"])
    width = max(4 * k, 64)
    left = numbered.withColumn("block", F.floor(F.col("pos") / width))
    right = left.select(F.col("id").alias("b"), F.col("t").alias("tb"), F.col("pos").alias("pb"), F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"))
    met = left.join(right, "block").filter((F.abs(F.col("pos") - F.col("pb")) <= k) & (F.col("id") != F.col("b")))
    gap = F.abs(F.col("t") - F.col("tb"))
    best = met.withColumn("gap", gap).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("gap", "b"))).filter(F.col("r") <= k)
    earlier = (F.col("tb") < F.col("t")) | ((F.col("tb") == F.col("t")) & (F.col("b") < F.col("id")))
    return best.select(F.col("id").alias("a"), "b", (F.col("gap") / 1e6).alias("gap_s"), F.when(earlier, "TEMPORAL_AFTER").otherwise("TEMPORAL_BEFORE").alias("relation"))


def positions(df: DataFrame, order: list[str], name: str = "pos", *, weight: str | None = None) -> DataFrame:
    """Number rows from 1 in a total order without one big window: range-partition by the order, number inside each
    partition, and add the sizes of the partitions before (one small row per partition). With ``weight`` a row counts as
    many as that column says, and has the number of the last of them."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) for c in order]
    from noesis.session import cut

    parted = cut(df.repartitionByRange(n, *cols).withColumn("_part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_part").orderBy(*cols)
    own = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) if weight else F.row_number().over(w)
    inside = parted.withColumn("_row", own)
    sizes = parted.groupBy("_part").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return inside.join(F.broadcast(before), "_part").withColumn(name, F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def band_pairs(df: DataFrame, order: list[str], reach: int, payload: list[str]) -> DataFrame:
    """Pairs of rows at most ``reach`` positions apart in a total order, earlier first, as an equi-join: a row meets the rows
    of its own block of ``reach`` positions and of the next one. ``payload`` columns come as ``x`` and ``x_b``."""
    rows = positions(df, order).withColumn("block", F.floor(F.col("pos") / reach))
    left = rows.select(*payload, "pos", F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    right = rows.select(*[F.col(c).alias(f"{c}_b") for c in payload], F.col("pos").alias("pos_b"), "block")
    return left.join(right, "block").filter((F.col("pos_b") > F.col("pos")) & (F.col("pos_b") <= F.col("pos") + reach)).drop("block")


def previous_links(notes: DataFrame, at: Column, k: int = 3) -> DataFrame:
    """``a, b``: each note and its k predecessors in time order."""
    rows = notes.select("id", at.alias("t")).filter("t is not null")
    pairs = band_pairs(rows, ["t", "id"], k, ["id"])
    return pairs.select(F.col("id_b").alias("a"), F.col("id").alias("b"))
