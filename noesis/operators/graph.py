"""Graph operators on edge tables: spreading, sampling, PageRank, communities, leader clusters, densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noesis.operators import activation, ranking
from noesis.operators.joins import adjacency
from noesis.session import cut, mounted_dir


def spread(
    edges: DataFrame, seeds: DataFrame, *, rounds: int = 3, decay: float = 0.7, floor: float = 0.01, allowed: DataFrame | None = None, temporal_boost: float = 1.0, community: DataFrame | None = None, inhibition: float = 0.0,
    blend: tuple[DataFrame, float, float] | None = None, contradictions: bool = False, fold: DataFrame | None = None, normal: bool = True,
) -> DataFrame:
    """``query_id, node_id, score`` after spreading activation from ``seeds`` (query_id, node_id, score), many queries at once.

    A round multiplies along the two-way multiset of edges; the note's own activation is a self-row of weight 1, so each
    round reads the one before once. Activations under ``floor`` do not spread. Scores are divided by the largest of the
    query where that is positive. ``allowed`` (query_id, node_id) bounds where activation may go; temporal edges count
    ``temporal_boost`` times; in round index 2, notes that are not the best of their ``community`` (node_id, community)
    lose half of ``inhibition``. Without ``normal``, scores are not divided and a note keeps its own activation undecayed.

    Then, if given, in this order: ``blend`` (scores, their weight, the weight of activation) adds both up; ``contradictions``
    as ``ranking.contradiction_penalty``; ``fold`` (node_id, other) gives every note's score to its others, the best counts.

    A query reaches a share of all notes, so nothing per query and note is shuffled: queries run whole inside tasks against
    the graph in mapped files (``activation``). Where the shared folder is not mounted, ``spread_joined`` does it by joins."""
    if mounted_dir(edges.sparkSession) is None:
        out = spread_joined(edges, seeds, rounds=rounds, decay=decay, floor=floor, allowed=allowed, temporal_boost=temporal_boost, community=community, inhibition=inhibition, normal=normal)
        if blend is not None:
            out = ranking.blend({"other": blend[0], "spread": out}, {"other": blend[1], "spread": blend[2]})
        if contradictions:
            out = ranking.contradiction_penalty(cut(out, "blended"), edges)
        if fold is not None:
            out = out.join(fold, "node_id").groupBy("query_id", F.col("other").alias("node_id")).agg(F.max("score").alias("score"))
        return out
    both = adjacency(edges)
    links = both.select("src", "dst", _weight(temporal_boost).alias("w")).filter("src is not null and dst is not null and w is not null")
    notes = [seeds.select(F.col("node_id").alias("id"))]
    rows = seeds.select("query_id", "node_id", "score", F.lit(0).alias("kind"))
    if allowed is not None:
        rows = rows.unionByName(allowed.select("query_id", "node_id", F.lit(0.0).alias("score"), F.lit(1).alias("kind")))
    if blend is not None:
        other = cut(blend[0].select("query_id", "node_id", "score"), "other")
        notes.append(other.select(F.col("node_id").alias("id")))
        rows = rows.unionByName(other.withColumn("kind", F.lit(2)))
    if contradictions:
        rival = both.filter("edge_type = 'CONTRADICTS'").select(F.col("src").alias("node_id"), F.col("dst").alias("other"))
        notes += [rival.select(F.col("node_id").alias("id"))]
    if fold is not None:
        fold = cut(fold.select("node_id", "other"), "fold")
        notes.append(fold.select(F.col("other").alias("id")))
    layout = activation.lay_out(links, notes)
    inhibited = community is not None and inhibition > 0 and rounds > 2
    steps = activation.Steps(
        rounds, decay, floor, normal, allowed is not None, activation.table(layout, community.select("node_id", F.col("community").alias("value"))) if inhibited else None, inhibition * 0.5,
        blend[2] if blend else 1.0, blend[1] if blend else 0.0, activation.table(layout, rival) if contradictions else None, fold=activation.table(layout, fold) if fold is not None else None,
    )
    return activation.run(layout, rows, steps)


def _weight(temporal_boost: float) -> Column:
    return F.when(F.col("edge_type").isin("TEMPORAL_BEFORE", "TEMPORAL_AFTER"), F.col("weight") * temporal_boost).otherwise(F.col("weight")) if temporal_boost != 1.0 else F.col("weight")


def spread_joined(edges: DataFrame, seeds: DataFrame, *, rounds: int = 3, decay: float = 0.7, floor: float = 0.01, allowed: DataFrame | None = None, temporal_boost: float = 1.0, community: DataFrame | None = None, inhibition: float = 0.0, normal: bool = True) -> DataFrame:
    """``spread`` without its last steps by joins. Beyond three rounds the lineage is cut each third round."""
    links = adjacency(edges).select("src", "dst", _weight(temporal_boost).alias("w")).filter("src is not null and dst is not null and w is not null")
    act = seeds.select("query_id", F.col("node_id").alias("src"), F.col("score").alias("a"))
    top = Window.partitionBy("query_id")
    for n in range(rounds):
        live = act.filter(F.col("a") >= floor)
        own = live.select("query_id", F.col("src").alias("dst"), F.col("a").alias("s"))
        out = live.join(links, "src").select("query_id", "dst", (F.col("a") * F.col("w")).alias("s"))
        if allowed is not None:
            out = out.join(allowed.select("query_id", F.col("node_id").alias("dst")), ["query_id", "dst"], "left_semi")
        if not normal:
            act = act.unionByName(out.select("query_id", F.col("dst").alias("src"), (F.col("s") * decay).alias("a"))).groupBy("query_id", "src").agg(F.sum("a").alias("a"))
            continue
        new = own.unionByName(out).groupBy("query_id", "dst").agg((F.sum("s") * decay).alias("s"))
        if n == 2 and community is not None and inhibition > 0:
            new = inhibit(new.select("query_id", F.col("dst").alias("node_id"), F.col("s").alias("score")), community, inhibition * 0.5).select("query_id", F.col("node_id").alias("dst"), F.col("score").alias("s"))
        most = F.max("s").over(top)
        act = new.select("query_id", F.col("dst").alias("src"), F.when(most > 0, F.col("s") / most).otherwise(F.col("s")).alias("a"))
        if n % 3 == 2 and n + 1 < rounds:
            act = cut(act, "activation")
    return act.select("query_id", F.col("src").alias("node_id"), F.col("a").alias("score"))


def inhibit(scores: DataFrame, community: DataFrame, strength: float) -> DataFrame:
    """Per query and community of two or more notes, all but the best (smaller id on ties) keep 1 - strength."""
    s = scores.join(community, "node_id", "left")
    w = Window.partitionBy("query_id", "community")
    first = F.row_number().over(w.orderBy(F.desc("score"), "node_id"))
    lost = F.col("community").isNotNull() & (F.col("community") != -1) & (first > 1)
    return s.withColumn("score", F.when(lost, F.col("score") * (1 - strength)).otherwise(F.col("score"))).drop("community")


def subgraph(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``query_id, node_id``: seeds and their neighbours."""
    hop = seeds.select("query_id", F.col("node_id").alias("src")).join(adjacency(edges).select("src", "dst"), "src").select("query_id", F.col("dst").alias("node_id"))
    return seeds.select("query_id", "node_id").unionByName(hop).distinct()


def route(edges: DataFrame, seeds: DataFrame, community: DataFrame) -> DataFrame:
    """``query_id, node_id``: the subgraph cut down to the seeds' communities and their neighbours; queries whose seeds have
    no community keep the whole subgraph."""
    sub = cut(subgraph(edges, seeds), "subgraph")
    c = community.filter("community <> -1").select("node_id", "community")
    own = seeds.join(c, "node_id").select("query_id", "community").distinct()
    # the communities a note is in or next to: one row per note and community, whatever the number of queries
    beside = adjacency(edges).select(F.col("src").alias("at"), F.col("dst").alias("node_id")).join(c, "node_id").select(F.col("at").alias("node_id"), "community")
    reach = c.unionByName(beside).distinct()
    routed = sub.join(reach, "node_id").join(own, ["query_id", "community"], "left_semi").select("query_id", "node_id").distinct()
    return routed.unionByName(sub.join(own.select("query_id").distinct(), "query_id", "left_anti"))


def pagerank(edges: DataFrame, *, damping: float = 0.85, rounds: int = 500, tolerance: float = 1e-4) -> DataFrame:
    """``node_id, rank`` divided by the largest. Parallel edges keep their largest weight, weights of 0 or less drop out;
    rank of notes without outgoing edges is given to all. Stops when the change is below notes x tolerance."""
    e = edges.groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(F.max("weight").alias("w")).filter("w > 0 and src is not null and dst is not null")
    total = e.groupBy("src").agg(F.sum("w").alias("t"))
    share = cut(e.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")), "shares")
    nodes = cut(share.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(total.select(F.col("src").alias("id"), F.lit(True).alias("out")), "id", "left"), "rank-nodes")
    n = nodes.count()
    if n == 0:
        return nodes.select(F.col("id").alias("node_id"), F.lit(0.0).alias("rank"))
    rank = nodes.withColumn("r", F.lit(1.0 / n))
    for k in range(rounds):
        loose = rank.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("r"))), F.lit(0.0)).alias("loose"))
        got = rank.join(share, rank["id"] == share["src"]).groupBy("dst").agg(F.sum(F.col("r") * F.col("p")).alias("g"))
        new = rank.join(got, rank["id"] == got["dst"], "left").crossJoin(F.broadcast(loose))
        new = new.select("id", "out", F.col("r").alias("old"), ((1 - damping) / n + damping * (F.coalesce("g", F.lit(0.0)) + F.col("loose") / n)).alias("r"))
        new = cut(new, "rank")
        moved = new.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0]
        rank = new.drop("old")
        if moved < n * tolerance:
            break
    top = rank.agg(F.max("r").alias("most"))
    return rank.crossJoin(F.broadcast(top)).select(F.col("id").alias("node_id"), (F.col("r") / F.col("most")).alias("rank"))


def communities(edges: DataFrame, *, rounds: int = 10) -> DataFrame:
    """``node_id, community``: weighted label propagation, the same for any partitioning: in each round a note takes the label
    with the largest total weight among its neighbours and itself (weight 1), the smaller label on ties; labels are the
    smallest ids. Stops when fewer than one in a thousand changes."""
    links = adjacency(edges).filter("weight > 0 and src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    links = cut(links, "links")
    label = cut(links.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    n = label.count()
    for _ in range(rounds):
        votes = links.join(label.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "label", "w").unionByName(label.withColumn("w", F.lit(1.0)))
        best = votes.groupBy("id", "label").agg(F.round(F.sum("w"), 9).alias("w")).groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("m"), "label")).alias("b"))
        new = cut(best.select("id", F.col("b.label").alias("label")), "labels")
        moved = new.join(label.withColumnRenamed("label", "old"), "id").filter("label <> old").count()
        label = new
        if moved * 1000 < n:
            break
    return label.select(F.col("id").alias("node_id"), F.col("label").alias("community"))


def largest_communities(edges: DataFrame, *, least: int = 5) -> DataFrame:
    """``node_id, community`` where only the largest connected part is divided, if it has ``least`` notes, and all other notes
    have -1; communities are numbered from 0 by size, then smallest member."""
    from noesis.operators.components import connected_components

    e = cut(edges.select("source_id", "target_id", "weight", "edge_type"), "linked")
    part = cut(connected_components(e, "source_id", "target_id"), "parts")
    top = part.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1).filter(F.col("n") >= least).select("component")
    inside = cut(part.join(F.broadcast(top), "component", "left_semi").select("id"), "largest")
    own = e.join(inside.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    found = cut(communities(own), "communities")
    sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    from noesis.operators.joins import positions

    order = positions(sizes.withColumn("m", -F.col("n")), ["m", "community"]).select("community", (F.col("pos") - 1).alias("no"))
    every = part.select(F.col("id").alias("node_id"))
    return every.join(found.join(order, "community").select("node_id", "no"), "node_id", "left").select("node_id", F.coalesce("no", F.lit(-1)).alias("community"))


def cluster_rank(clusters: DataFrame, pairs: DataFrame, *, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """``leader, id, rank``: PageRank inside clusters (id, leader) along pairs (leader, a, b, similarity), weights divided by
    their sum per note; a note without a pair passes nothing on. A cluster is never gathered: rounds are joins."""
    both = pairs.select("leader", F.col("a").alias("src"), F.col("b").alias("dst"), "similarity").unionByName(pairs.select("leader", F.col("b").alias("src"), F.col("a").alias("dst"), "similarity"))
    total = both.groupBy("leader", "src").agg(F.sum("similarity").alias("t"))
    share = cut(both.join(total, ["leader", "src"]).select("leader", "src", "dst", (F.col("similarity") / F.col("t")).alias("p")), "cluster-shares")
    size = clusters.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    nodes = cut(clusters.select("leader", "id").join(size, "leader"), "cluster-notes")
    rank = nodes.withColumn("r", 1.0 / F.col("n"))
    for k in range(rounds):
        got = rank.select("leader", F.col("id").alias("src"), "r").join(share, ["leader", "src"]).groupBy("leader", F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("p")).alias("g"))
        rank = nodes.join(got, ["leader", "id"], "left").select("leader", "id", "n", ((1 - damping) / F.col("n") + damping * F.coalesce("g", F.lit(0.0))).alias("r"))
        if k % 5 == 4:
            rank = cut(rank, "cluster-rank")
    return rank.select("leader", "id", F.when(F.col("n") == 1, 1.0).otherwise(F.col("r")).alias("rank"))


def leader_clusters(notes: DataFrame, similar: DataFrame, *, least: int = 3) -> DataFrame:
    """``id, leader`` of first-come clusters: in id order a note not yet taken leads, and takes every later note similar to
    it that is not yet taken; clusters under ``least`` notes vanish, their members stay taken.

    ``similar`` (a, b, a < b) is the similarity graph. A note leads if no earlier neighbour leads: the lexicographically
    first independent set, settled in rounds; a round decides every note whose earlier neighbours are all decided."""
    pairs = cut(similar.select("a", "b").distinct(), "similar")
    leads = cut(notes.select("id").join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(True).alias("leads")), "leads")
    open_ = cut(notes.select("id").join(leads, "id", "left_anti"), "open")
    known = leads
    while open_.limit(1).count():  # a round decides at least the smallest open id
        state = pairs.join(open_.select(F.col("id").alias("b")), "b", "left_semi").join(known.withColumnRenamed("id", "a"), "a", "left").groupBy("b").agg(F.max(F.coalesce(F.col("leads"), F.lit(False))).alias("beaten"), F.min(F.col("leads").isNotNull()).alias("all"))
        new = cut(state.filter("beaten or all").select(F.col("b").alias("id"), (~F.col("beaten")).alias("leads")), "decided")
        known = cut(known.unionByName(new), "known")
        open_ = cut(open_.join(new, "id", "left_anti"), "open")
    lead = known.filter("leads").select("id")
    taken = pairs.join(lead.withColumnRenamed("id", "a"), "a", "left_semi").join(known.filter("not leads").select(F.col("id").alias("b")), "b", "left_semi").groupBy("b").agg(F.min("a").alias("leader"))
    rows = taken.select(F.col("b").alias("id"), "leader").unionByName(lead.withColumn("leader", F.col("id")))
    sizes = rows.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return rows.join(sizes.select("leader"), "leader", "left_semi").select("id", "leader")


def cluster_links(clusters: DataFrame, *, all_up_to: int = 10, star_up_to: int = 50) -> DataFrame:
    """``source_id, target_id``: all pairs of small clusters, a star from the leader of middling ones, none of large ones."""
    sizes = clusters.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= star_up_to)
    c = clusters.join(sizes, "leader")
    a, b = c.filter(F.col("n") <= all_up_to).select("leader", F.col("id").alias("source_id")), c.select("leader", F.col("id").alias("target_id"))
    pairs = a.join(b, "leader").filter("source_id < target_id").select("source_id", "target_id")
    star = c.filter((F.col("n") > all_up_to) & (F.col("id") != F.col("leader"))).select(F.col("leader").alias("source_id"), F.col("id").alias("target_id"))
    return pairs.unionByName(star)


def density(edges: DataFrame, members: DataFrame, *, least: int = 5) -> DataFrame:
    """``members, internal, density``: tanh(20 d) of the directed edges inside ``members`` (id); 0 under ``least`` members."""
    e = edges.select("source_id", "target_id")
    for side in ("source_id", "target_id"):
        e = e.join(members.select(F.col("id").alias(side)), side, "left_semi")
    n = members.agg(F.count(F.lit(1)).alias("members"))
    d = F.col("internal") / F.greatest(F.col("members") * (F.col("members") - 1), F.lit(1))
    return e.agg(F.count(F.lit(1)).alias("internal")).crossJoin(n).select("members", "internal", F.when(F.col("members") >= least, F.tanh(d * 20)).otherwise(0.0).alias("density"))


def cross_community(edges: DataFrame, community: DataFrame) -> DataFrame:
    """``crossing, mean_weight``: edges between different communities."""
    c = community.filter("community <> -1")
    e = edges.select("source_id", "target_id", "weight").join(c.select(F.col("node_id").alias("source_id"), F.col("community").alias("ca")), "source_id").join(c.select(F.col("node_id").alias("target_id"), F.col("community").alias("cb")), "target_id")
    return e.filter("ca <> cb").agg(F.count(F.lit(1)).alias("crossing"), F.avg("weight").alias("mean_weight"))
