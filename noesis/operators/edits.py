"""Changes to tables as new frames: upserts, merges, deletions, decay, boosts. Nothing is written in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noesis.functions import times

KEY = ["source_id", "target_id", "edge_type"]


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (source, target, type) with the largest weight and the earliest creation."""
    both = edges.select(*KEY, "weight", "created_at").unionByName(new.select(*KEY, "weight", "created_at"))
    return both.groupBy(*KEY).agg(F.max("weight").alias("weight"), F.min("created_at").alias("created_at"))


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Only the new edges whose triple is not there; of repeated ones the heaviest."""
    once = new.groupBy(*KEY).agg(F.max("weight").alias("weight"), F.min("created_at").alias("created_at"))
    return once.join(edges.select(*KEY).distinct(), KEY, "left_anti")


def replace_edges(edges: DataFrame, new: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges with all rows of the given types replaced: what makes a step repeatable."""
    return edges.filter(~F.col("edge_type").isin(kinds) | F.col("edge_type").isNull()).unionByName(new)


def delete_notes(nodes: DataFrame, edges: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes, edges and links without the notes of ``gone`` (id)."""
    g = gone.select("id").distinct()
    e = edges
    for side in ("source_id", "target_id"):
        e = e.join(g.select(F.col("id").alias(side)), side, "left_anti")
    return nodes.join(g, "id", "left_anti"), e, links.join(g.select(F.col("id").alias("node_id")), "node_id", "left_anti")


def merge_entities(entities: DataFrame, links: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities without the removed ones and links moved to those kept; mapping (remove_id, keep_id)."""
    m = mapping.groupBy("remove_id").agg(F.min("keep_id").alias("keep_id"))
    moved = links.join(m, links["entity_id"] == m["remove_id"], "left").select("node_id", F.coalesce("keep_id", "entity_id").alias("entity_id")).distinct()
    return entities.join(m.select(F.col("remove_id").alias("id")), "id", "left_anti"), moved


def touched(nodes: DataFrame, accesses: DataFrame) -> DataFrame:
    """Notes with access events (node_id, at) added up: count and last time."""
    a = accesses.groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("hits"), F.max("at").alias("seen"))
    n = nodes.join(a, "id", "left")
    return n.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("hits", F.lit(0))).withColumn("last_accessed", F.greatest("last_accessed", "seen")).drop("hits", "seen")


def latest_versions(versions: DataFrame, keep: int = 5) -> DataFrame:
    w = Window.partitionBy("note_id").orderBy(F.desc("version_number"))
    return versions.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep).drop("r")


def pruned(edges: DataFrame, least: float, kind: str = "semantic") -> DataFrame:
    return edges.filter(~((F.col("edge_type") == kind) & (F.col("weight") < least)))


def decayed(edges: DataFrame, protected_ids: DataFrame, stale: Column, factor: float = 0.95) -> DataFrame:
    """Stale edges lose weight unless an end is protected (id)."""
    p = protected_ids.select("id").distinct().withColumn("safe", F.lit(True))
    e = edges
    for side in ("source_id", "target_id"):
        e = e.join(p.select(F.col("id").alias(side), F.col("safe").alias(f"safe_{side}")), side, "left")
    fades = stale & F.coalesce("safe_source_id", "safe_target_id").isNull()
    return e.withColumn("weight", F.when(fades, F.col("weight") * factor).otherwise(F.col("weight"))).drop("safe_source_id", "safe_target_id")


def boosted(nodes: DataFrame, categories: DataFrame) -> DataFrame:
    """Notes of protected categories (category, lower-case) become critical."""
    safe = categories.select(F.col("category").alias("_c")).distinct().withColumn("_safe", F.lit(True))
    n = nodes.join(safe, F.lower(nodes["category"]) == safe["_c"], "left")
    return n.withColumn("importance", F.when(F.col("_safe"), "critical").otherwise(F.col("importance"))).drop("_c", "_safe")


def prospective(nodes: DataFrame, today: str) -> DataFrame:
    """Intentions: pending ones become critical, overdue ones are marked once, finished critical ones become low."""
    tags, mine = F.coalesce("tags", F.lit("")), F.col("category") == "prospective"
    pending = mine & tags.contains("pending")
    finished = mine & ~tags.contains("pending") & (tags.contains("done") | tags.contains("cancelled"))
    late = pending & (times.due_date("tags") < today) & ~F.col("content").contains("OVERDUE")
    return nodes.withColumn("content", F.when(late, F.concat(F.lit("[OVERDUE] "), "content")).otherwise(F.col("content"))).withColumn(
        "importance", F.when(pending, "critical").when(finished & (F.col("importance") == "critical"), "low").otherwise(F.col("importance"))
    )


def number_new(batch: DataFrame, taken: DataFrame, order: list[str]) -> DataFrame:
    """Ids for new rows, continuing behind the largest id taken, in a total order."""
    from noesis.operators.joins import positions

    top = taken.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return positions(batch, order, "_n").crossJoin(F.broadcast(top)).withColumn("id", F.col("_n") + F.col("top")).drop("_n", "top")
