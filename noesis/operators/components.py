"""Connected components of a pair list, by hash-to-min over labels with pointer jumping; lineage is cut every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noesis.session import cut


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component``: the smallest id reachable from each id that occurs in ``pairs``.

    Runs until no edge changes any more. Alternates large-star and small-star steps (each node links its neighbours to the least of them), which needs
    O(log n) rounds even on chains and moves at most the edges once a round. A hub with a third of all pairs is only
    aggregated by min, map-side first, and joined once; no neighbour list is built. Null ends and self-pairs are ignored.
    """
    edges = pairs.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u is not null and v is not null")
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        after = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        # done when every edge points from a member to a root that is no member itself
        open_ = after.select("u").intersect(after.select("v")).limit(1).count() or after.groupBy("u").count().filter("count > 1").limit(1).count()
        edges = after
        if not open_:
            break
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
