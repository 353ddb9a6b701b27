"""Signals of a graph's structure and what its notes say of themselves, their sums, and logs of them over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noesis import vocabulary as V
from noesis.operators import ranking


def counted(nodes: DataFrame) -> DataFrame:
    """Notes that count: of no category made by the store; a null category does not count."""
    return nodes.filter(~F.col("category").isin(V.NOT_COUNTED))


def hub_reach(edges: DataFrame, nodes: DataFrame, *, hubs: int = 5, first: int = 2000, second_from: int = 100, second: int = 200) -> DataFrame:
    """``reached, total, reach``: what share of the notes that count is reached from the largest hubs in two steps. A hub
    gives its ``first`` smallest targets, the ``second_from`` smallest of these ``second`` each: bounds of the measure."""
    e = edges.select("source_id", "target_id")
    top = e.groupBy("source_id").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "source_id").limit(hubs).select("source_id")
    by = Window.partitionBy("source_id").orderBy("target_id")
    near = e.join(F.broadcast(top), "source_id").withColumn("r", F.row_number().over(by)).filter(F.col("r") <= first)
    via = near.filter(F.col("r") <= second_from).select(F.col("target_id").alias("source_id")).distinct()
    far = e.join(via, "source_id", "left_semi").withColumn("r", F.row_number().over(by)).filter(F.col("r") <= second)
    ids = top.select(F.col("source_id").alias("id")).unionByName(near.select(F.col("target_id").alias("id"))).unionByName(far.select(F.col("target_id").alias("id")))
    reached = ids.agg(F.countDistinct("id").alias("reached"))
    total = counted(nodes).agg(F.count(F.lit(1)).alias("total"))
    return reached.crossJoin(total).withColumn("reach", F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("reached") / F.col("total"))).otherwise(0.0))


def reflection(nodes: DataFrame) -> DataFrame:
    """``by_category, by_word, total, reflection``: the larger of the notes in reflecting categories and those with reflecting
    words (of all categories), as a share of the notes that count."""
    words = F.lit(False)
    for w in V.META_WORDS:
        words |= F.col("content").ilike(f"%{w}%") if w.isascii() else F.col("content").contains(w)
    row = nodes.agg(F.count_if(F.col("category").isin(V.RECALL_META)).alias("by_category"), F.count_if(words).alias("by_word"), F.count_if(~F.col("category").isin(V.NOT_COUNTED)).alias("total"))
    share = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.greatest("by_category", "by_word") / F.col("total"))).otherwise(0.0)
    return row.withColumn("reflection", share)


def convergence(edges: DataFrame, nodes: DataFrame, *, seeds: int = 5, rounds: int = 3, keep: float = 0.5, spread: float = 0.7, floor: float = 0.01, start: DataFrame | None = None) -> DataFrame:
    """``seeds, convergence``: from single notes (``start``, else the first by a hash of their id) activation goes along outgoing edges; the
    mean share of all activation that the most active note has in the end."""
    chosen = start if start is not None else nodes.select("id").orderBy(F.xxhash64("id"), "id").limit(seeds)
    act = chosen.select(F.col("id").alias("query_id"), F.col("id").alias("src"), F.lit(1.0).alias("a"))
    links = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("weight").alias("w")).filter("w is not null")
    w = Window.partitionBy("query_id")
    for _ in range(rounds):
        live = act.filter(F.col("a") >= floor)
        own = live.select("query_id", F.col("src").alias("dst"), (F.col("a") * keep).alias("s"))
        out = live.join(links, "src").select("query_id", "dst", (F.col("a") * F.col("w") * spread).alias("s"))
        new = own.unionByName(out).groupBy("query_id", "dst").agg(F.sum("s").alias("s"))
        most = F.max("s").over(w)
        act = new.select("query_id", F.col("dst").alias("src"), F.when(most > 0, F.col("s") / most).otherwise(F.col("s")).alias("a"))
    per = act.groupBy("query_id").agg(F.max("a").alias("m"), F.sum("a").alias("t"))
    return per.agg(F.count(F.lit(1)).alias("seeds"), F.coalesce(F.avg(F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(0.0)), F.lit(0.0)).alias("convergence"))


def community_phi(edges: DataFrame, community: DataFrame, nodes: DataFrame) -> DataFrame:
    """``crossing, mean_weight, isolated, phi``: tanh(raw / 30) of raw = crossing edges x their mean weight / (notes x
    (notes without community + 1))."""
    from noesis.operators.graph import cross_community

    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    inside = community.filter("community <> -1").agg(F.countDistinct("node_id").alias("inside"))
    row = cross_community(edges, community).crossJoin(n).crossJoin(inside)
    isolated = F.greatest(F.lit(0), F.col("n") - F.col("inside"))
    raw = F.coalesce(F.col("crossing") * F.col("mean_weight") / (F.col("n") * (isolated + 1)), F.lit(0.0))
    return row.select("crossing", F.coalesce("mean_weight", F.lit(0.0)).alias("mean_weight"), isolated.alias("isolated"), F.tanh(raw / 30.0).alias("phi"))


def self_precision(queries: DataFrame, nodes: DataFrame, *, k: int = 5) -> DataFrame:
    """``queries, precision``: of the ``k`` nearest notes that count of each query (query_id, embedding), the mean share in
    categories about the store itself; places that are not filled count as misses."""
    near = ranking.nearest(queries, counted(nodes).select("id", "embedding"), k=k, least=-1.0)
    hit = near.join(nodes.select(F.col("id").alias("node_id"), F.col("category").isin(V.SELF_REFERENCE).cast("int").alias("h")), "node_id").groupBy("query_id").agg((F.sum("h") / k).alias("p"))
    every = queries.select("query_id").distinct().join(hit, "query_id", "left")
    return every.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.avg(F.coalesce("p", F.lit(0.0))), F.lit(0.0)).alias("precision"))


def emergence(convergence: Column, phi: Column, precision: Column) -> Column:
    return 0.3 * convergence + 0.4 * phi + 0.3 * precision


def weighted(row: DataFrame) -> DataFrame:
    """A row of the eight signals with their weighted sum (``composite``) and the weakest one (``bottleneck``, the first in
    the list on ties)."""
    w = V.SIGNAL_WEIGHTS
    total = sum((F.col(name) * share for name, share in w.items()), F.lit(0.0))
    weakest = F.array_min(F.array(*[F.struct(F.col(name).alias("v"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, name in enumerate(w)]))
    return row.withColumn("composite", total).withColumn("bottleneck", weakest["name"])


def with_change(log: DataFrame, value: str, at: str = "timestamp") -> DataFrame:
    """A log with the difference of ``value`` to the row before in time; logs have a row per run and are small."""
    return log.withColumn("change", F.col(value) - F.lag(value).over(Window.orderBy(at)))


def trend(log: DataFrame, value: str, at: str = "timestamp") -> DataFrame:
    """``runs, first, latest, least, most, mean`` of a log's value."""
    return log.agg(F.count(F.lit(1)).alias("runs"), F.min_by(value, at).alias("first"), F.max_by(value, at).alias("latest"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def latest(log: DataFrame, n: int = 1, at: str = "timestamp") -> DataFrame:
    """The last ``n`` rows of a log, newest first."""
    return log.orderBy(F.desc(at)).limit(n)
