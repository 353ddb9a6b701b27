"""Scoring steps of retrieval on (query_id, node_id, ...) frames."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noesis import vocabulary as V
from noesis.operators.joins import adjacency

QUERY_BLOCK = 4096
#: More than any number of notes: all of them above the bound are wanted.
ALL = 1 << 30


def nearest(queries: DataFrame, base: DataFrame, *, k: int = 10, dim: int = 128, least: float = 0.0, without: DataFrame | None = None) -> DataFrame:
    """``query_id, node_id, score``: exact k nearest of a stated query set (query_id, embedding) among all rows of ``base``
    (id, embedding), smaller id on ties; pairs ``without`` (query_id, node_id) are left out, with k from ``ALL`` on every row
    of ``base`` from ``least`` on is wanted.

    Every task scans its rows of ``base``, which are never shuffled, against all queries and keeps its own k best per query;
    these are merged by a window. Up to ``QUERY_BLOCK`` queries, counted first, go to every task with its code; more lie in
    mapped files in the shared folder, which all tasks read block by block. Where that folder is not mounted, queries and
    rows are dealt to blocks and parts that meet in tasks of their own."""
    from noesis.session import cut, mounted_dir, slots

    schema = "query_id long, node_id long, score double"
    spark = base.sparkSession
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").filter("embedding is not null")
    if without is not None:
        known = without.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.collect_list(F.col("node_id").cast("long")).alias("known"))
        asked = asked.join(known, "query_id", "left")
    else:
        asked = asked.withColumn("known", F.lit(None).cast("array<bigint>"))
    some = asked.limit(QUERY_BLOCK + 1).toArrow()
    if not some.num_rows:
        return spark.createDataFrame([], schema)
    rows = base.select(F.col("id").cast("long").alias("id"), "embedding")
    if some.num_rows <= QUERY_BLOCK:
        stated = _Asked.of(some, dim)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _scan(stated.blocks(), batches, k, dim, least)

        out = rows.mapInArrow(scan, schema)
    elif (top := mounted_dir(spark)) is not None:
        folder = os.path.join(top, f"noesis-queries-{uuid.uuid4().hex}")
        os.makedirs(folder)

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len((got := _Asked.of(pa.Table.from_batches([b]), dim)).ids):
                    yield pa.RecordBatch.from_pylist([{"name": got.save(os.path.join(folder, uuid.uuid4().hex))}])

        names = sorted(r.name for r in asked.mapInArrow(store, "name string").collect())

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _scan([x for n in names for x in _Asked.load(n).blocks()], batches, k, dim, least)

        out = rows.mapInArrow(mapped, schema)
    else:
        asked = cut(asked, "queries")
        blocks, parts = -(-asked.count() // QUERY_BLOCK), max(slots(spark), -(-rows.count() // 50_000))
        of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.select("query_id", "embedding", "known", of("query_id", blocks).alias("block")).withColumn("part", every(parts))
        right = rows.select("id", "embedding", of("id", parts).alias("part")).withColumn("block", every(blocks))

        def both(x: pa.Table, y: pa.Table) -> pa.Table:
            got = list(_scan(_Asked.of(x, dim).blocks(), y.to_batches(), k, dim, least)) if x.num_rows else []
            return pa.Table.from_batches(got, pa.schema([("query_id", pa.int64()), ("node_id", pa.int64()), ("score", pa.float64())]))

        out = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(both, schema)
    if k >= ALL:
        return out
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return out.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


@dataclass
class _Asked:
    """Queries: ids, normalised vectors in double and single precision, and ids that are left out (rows filled up with the
    least integer)."""

    ids: np.ndarray
    exact: np.ndarray
    quick: np.ndarray
    known: np.ndarray

    @classmethod
    def of(cls, t: pa.Table, dim: int) -> _Asked:
        from noesis.operators.cells import unit_rows

        column = t["embedding"].combine_chunks()
        usable, v = unit_rows(column.cast(pa.list_(pa.float64())), dim)
        lists = [x or [] for x in t["known"].combine_chunks().filter(pa.array(usable)).to_pylist()]
        known = np.full((len(lists), max(map(len, lists), default=0)), np.iinfo(np.int64).min)
        for i, x in enumerate(lists):
            known[i, : len(x)] = x
        return cls(np.asarray(t["query_id"].combine_chunks())[usable], v, v.astype(np.float32), known)

    def blocks(self, rows: int = 1024) -> list[_Asked]:
        return [_Asked(*(x[i : i + rows] for x in (self.ids, self.exact, self.quick, self.known))) for i in range(0, len(self.ids), rows)]

    def save(self, name: str) -> str:
        for part in ("ids", "exact", "quick", "known"):
            np.save(f"{name}.{part}.npy", getattr(self, part))
        return name

    @classmethod
    def load(cls, name: str) -> _Asked:
        return cls(*(np.asarray(np.load(f"{name}.{part}.npy", mmap_mode="r")) if part != "known" else np.load(f"{name}.known.npy") for part in ("ids", "exact", "quick", "known")))


def _scan(blocks: list[_Asked], batches: Iterator[pa.RecordBatch], k: int, dim: int, least: float) -> Iterator[pa.RecordBatch]:
    """The k best of each query among the rows (id, vector) of all batches, smaller id on ties. Products in single precision
    leave out what is surely behind the k found so far; what is left is ranked in double precision."""
    from noesis.operators.cells import unit_rows

    def table(qids: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(qids), pa.array(ids), pa.array(score)], names=["query_id", "node_id", "score"])

    def shortened(i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -score, i))
        i, ids, score = i[order], ids[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[keep], ids[keep], score[keep]

    margin = 1e-5  # more than products of unit vectors in single precision are off
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in blocks]
    bound, full = [np.full(len(b.ids), least) for b in blocks], [False] * len(blocks)
    for whole in batches:
        for at in range(0, whole.num_rows, 8192):
            b = whole.slice(at, 8192)
            usable, v = unit_rows(b.column(1), dim)
            if not len(v):
                continue
            ids, quick = np.asarray(b.column(0))[usable], v.astype(np.float32)
            by_id = np.argsort(ids, kind="stable")
            for n, q in enumerate(blocks):
                score = q.exact @ v.T if k >= ALL else q.quick @ quick.T
                if q.known.shape[1]:
                    lo, hi = (np.searchsorted(ids, q.known, side=s, sorter=by_id) for s in ("left", "right"))
                    while (some := lo < hi).any():  # an id may be there several times
                        i, j = np.nonzero(some)
                        score[i, by_id[lo[i, j]]] = -np.inf
                        lo = lo + some
                if k >= ALL:
                    i, j = np.nonzero(score >= least)
                    if len(i):
                        yield table(q.ids[i], ids[j], score[i, j])
                    continue
                wanted = bound[n] - margin
                part = score[:, :4096]
                if not full[n] and part.shape[1] > k:  # some query has no k rows yet: the k best of this part bound it
                    wanted = np.maximum(wanted, np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k] - 2 * margin)
                i, j = np.divmod(np.flatnonzero(score >= wanted[:, None]), len(ids))
                exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q.exact[i[m : m + 50_000]], v[j[m : m + 50_000]]) for m in range(0, len(i), 50_000))])
                fit = (exact >= bound[n][i]) & (score[i, j] > -np.inf)
                held[n] = tuple(np.concatenate(x) for x in zip(held[n], (i[fit], ids[j[fit]], exact[fit]), strict=True))
                if not full[n] or len(held[n][0]) > 2 * k * len(q.ids):
                    held[n] = shortened(*held[n])
                    row = held[n][0]
                    enough = np.bincount(row, minlength=len(q.ids)) >= k
                    last = np.flatnonzero(np.r_[row[1:] != row[:-1], np.ones(min(1, len(row)), bool)])
                    last = last[enough[row[last]]]
                    bound[n][row[last]] = held[n][2][last]
                    full[n] = bool(enough.all())
    if k < ALL:
        for q, h in zip(blocks, held, strict=True):
            i, ids, score = shortened(*h)
            if len(i):
                yield table(q.ids[i], ids, score)


def recency(last: Column, created: Column, category: Column, now: str, *, half_life: float = 30.0) -> Column:
    """0.5 ** (whole days / half-life), at least 0.1; slowed by category; 0.5 without a time; 1 for anchors."""
    at = F.coalesce(last, created)
    days = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at)) / F.lit(86_400_000_000))
    plain = F.greatest(F.lit(0.1), F.pow(F.lit(0.5), days / F.lit(half_life)))
    slow = F.create_map(*[F.lit(x) for p in V.DECAY_FACTORS.items() for x in p])
    factor = F.coalesce(F.element_at(slow, category), F.lit(1.0))
    slowed = F.greatest(F.lit(0.1), 1.0 - (1.0 - plain) * factor)
    return F.when(category == "anchor", 1.0).when(at.isNull(), 0.5).when(factor < 1.0, slowed).otherwise(plain)


def importance(level: Column, accesses: Column) -> Column:
    base = F.create_map(*[F.lit(x) for p in V.IMPORTANCE_FACTORS.items() for x in p])
    return F.coalesce(F.element_at(base, level), F.lit(1.0)) + F.least(F.lit(0.2), F.coalesce(accesses, F.lit(0)) * 0.01)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Share of the interval b that a covers, at most 1; 0 without overlap."""
    s = lambda c: F.unix_micros(c) / F.lit(1e6)
    both = F.least(s(a1), s(b1)) - F.greatest(s(a0), s(b0))
    whole = s(b1) - s(b0)
    return F.when((both > 0) & (whole > 0), F.least(F.lit(1.0), both / whole)).otherwise(0.0)


def normalise(scores: DataFrame, column: str = "score") -> DataFrame:
    """Divide by the largest of the query, where positive."""
    most = F.max(column).over(Window.partitionBy("query_id"))
    return scores.withColumn(column, F.when(most > 0, F.col(column) / most).otherwise(F.col(column)))


def blend(signals: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """``query_id, node_id, score``: weighted sum over the union of the signals' notes; a missing signal counts 0."""
    parts = [df.select("query_id", "node_id", (F.col("score") * weights[name]).alias("s")) for name, df in signals.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("query_id", "node_id").agg(F.sum("s").alias("score"))


def reciprocal_ranks(signals: list[DataFrame], k: int = 60) -> DataFrame:
    """Sum of 1 / (k + place), place from 1, over signals where the score is positive; ties by smaller id."""
    out = None
    for df in signals:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
        p = df.filter("score > 0").select("query_id", "node_id", (1.0 / (k + F.row_number().over(w))).alias("s"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("query_id", "node_id").agg(F.sum("s").alias("score"))


def hub_penalty(scores: DataFrame, links: DataFrame, most: int = 20) -> DataFrame:
    """Notes with more than ``most`` entities keep most / entities of their score."""
    n = links.select("node_id", "entity_id").distinct().groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    return scores.join(n, "node_id", "left").withColumn("score", F.when(F.col("n").isNotNull(), F.col("score") * most / F.col("n")).otherwise(F.col("score"))).drop("n")


def contradiction_penalty(scores: DataFrame, edges: DataFrame, *, least: float = 0.3, keep: float = 0.3) -> DataFrame:
    """A note with a CONTRADICTS neighbour of score above ``least`` keeps ``keep`` of its own, judged on the scores as given.
    Scores are used twice, so a frame that is dear to compute should be cut before."""
    pairs = adjacency(edges.filter("edge_type = 'CONTRADICTS'")).select("src", "dst").distinct()
    rival = scores.filter(F.col("score") > least).select("query_id", F.col("node_id").alias("dst")).join(pairs, "dst").select("query_id", F.col("src").alias("node_id")).distinct().withColumn("hit", F.lit(True))
    return scores.join(rival, ["query_id", "node_id"], "left").withColumn("score", F.when(F.col("hit"), F.col("score") * keep).otherwise(F.col("score"))).drop("hit")


def part_inhibition(scores: DataFrame, parents: DataFrame, strength: float = 0.6) -> DataFrame:
    """Of the parts (id, parent) of one parent all but the best keep 1 - strength."""
    s = scores.join(parents.select(F.col("id").alias("node_id"), "parent"), "node_id", "left")
    first = F.row_number().over(Window.partitionBy("query_id", "parent").orderBy(F.desc("score"), "node_id"))
    lost = F.col("parent").isNotNull() & (first > 1)
    return s.withColumn("score", F.when(lost, F.col("score") * (1 - strength)).otherwise(F.col("score"))).drop("parent")


def top(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "node_id")
    return scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def temporal_place(notes: DataFrame, direction: str = "direction") -> DataFrame:
    """``query_id, node_id, score`` of candidates (query_id, node_id, at, direction): where a note's time lies between the
    earliest and the latest of its query, from the end for "before", 0.5 for other directions or equal times; 0 without a
    time."""
    w, t = Window.partitionBy("query_id"), F.unix_micros("at")
    first, last = F.min(t).over(w), F.max(t).over(w)
    place = (t - first) / (last - first).cast("double")
    aimed = F.when(F.col(direction) == "before", 1.0 - place).when(F.col(direction) == "after", place).otherwise(0.5)
    return notes.select("query_id", "node_id", F.when(t.isNull(), 0.0).when(last == first, 0.5).otherwise(aimed).alias("score"))


def boosted(scores: DataFrame, wanted: DataFrame, *, by: float, least: float) -> DataFrame:
    """Scores of ``wanted`` notes (query_id, node_id, score: their similarity) raised by ``by``: those scored already up to 1,
    the others come in from a similarity of ``least`` on, uncapped."""
    w = wanted.groupBy("query_id", "node_id").agg(F.max("score").alias("_s"))
    both = scores.join(w, ["query_id", "node_id"], "full_outer")
    new = F.when(F.col("_s").isNull(), F.col("score")).when(F.col("score").isNotNull(), F.least(F.lit(1.0), F.col("score") + by)).when(F.col("_s") >= least, F.col("_s") + by)
    return both.select("query_id", "node_id", new.alias("score")).filter("score is not null")


def boosted_nearest(queries: DataFrame, near: DataFrame, kinds: DataFrame, *, by: float, least: float) -> DataFrame:
    """``boosted`` where ``wanted`` are all notes of ``kinds`` (id, embedding) and scores are their similarity too: those among
    the nearest are told by their id, and the scan leaves them out, so that the many others go straight to the result."""
    own = kinds.select(F.col("id").alias("node_id"), F.lit(True).alias("_own"))
    raised = near.join(own, "node_id", "left").select("query_id", "node_id", F.when(F.col("_own") & (F.col("score") >= 0), F.least(F.lit(1.0), F.col("score") + by)).otherwise(F.col("score")).alias("score"))
    brought = nearest(queries, kinds, k=ALL, least=least, without=near).select("query_id", "node_id", (F.col("score") + by).alias("score"))
    return raised.unionByName(brought)


def group_best(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """Every member of a group (node_id, grp) of scored notes gets the best score of the group in its query."""
    s = scores.join(groups.select("node_id", "grp"), "node_id", "left")
    best = F.max("score").over(Window.partitionBy("query_id", "grp"))
    return s.select("query_id", "node_id", F.when(F.col("grp").isNotNull(), best).otherwise(F.col("score")).alias("score"))


def between_ends(scores: DataFrame, column: str = "score") -> DataFrame:
    """Scores moved to [0, 1] by the least and largest of their query; 0.5 where these are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min(column).over(w), F.max(column).over(w)
    return scores.withColumn(column, F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(0.5))


def reranked(scores: DataFrame, judged: DataFrame, *, weight: float = 0.3, first: int = 20) -> DataFrame:
    """The ``first`` notes of each query with their score and that of a pair judge (query_id, node_id, score), moved to
    [0, 1], in the proportion 1 - weight to weight; the others stay as they are behind them."""
    t = top(scores.select("query_id", "node_id", "score"), first).drop("place")
    j = between_ends(judged.join(t.select("query_id", "node_id"), ["query_id", "node_id"], "left_semi")).select("query_id", "node_id", F.col("score").alias("_j"))
    new = t.join(j, ["query_id", "node_id"], "left").withColumn("score", F.when(F.col("_j").isNotNull(), F.col("score") * (1 - weight) + F.col("_j") * weight).otherwise(F.col("score"))).drop("_j")
    return new.unionByName(scores.select("query_id", "node_id", "score").join(t.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti"))


def rank_factor(rank: Column, weight: float = 0.1) -> Column:
    """Factor of a note by its PageRank (0 to 1); not part of the search."""
    return 1.0 + weight * F.coalesce(rank, F.lit(0.0))


def folds(parents: DataFrame, category: DataFrame) -> DataFrame:
    """``node_id, other``: what ``whole_for_part`` counts each note as, for ``graph.spread``: itself, or its parent for a
    fragment; notes that it drops have no row."""
    kinds = category.select("id", "category")
    part = F.coalesce(F.col("category").isin(V.FRAGMENTS), F.lit(False))
    own = kinds.filter(~part & (F.col("category").isNull() | (F.col("category") != "abstract-topic"))).select(F.col("id").alias("node_id"), F.col("id").alias("other"))
    lifted = kinds.filter(part).join(parents.select("id", "parent"), "id").select(F.col("id").alias("node_id"), F.col("parent").alias("id"))
    known = kinds.filter(F.col("category").isNull() | ~F.col("category").isin("abstract-topic", "atomic-fact", "enriched-fragment")).select("id")
    return own.unionByName(lifted.join(known, "id", "left_semi").select("node_id", F.col("id").alias("other")))


def rounded(score: Column | str, digits: int = 4) -> Column:
    """Half away from zero, as ``round`` does, by plain arithmetic: ``round`` of a double goes through decimals, which takes
    longer than all else where a result has hundreds of millions of rows."""
    x, unit = F.col(score) if isinstance(score, str) else score, 10.0**digits
    return F.when(x < 0, -F.floor(0.5 - x * unit)).otherwise(F.floor(x * unit + 0.5)) / unit


def whole_for_part(scores: DataFrame, parents: DataFrame, category: DataFrame) -> DataFrame:
    """Fragments replaced by their parent: ``query_id, node_id, score`` where a fragment's score stands for its parent
    (id, parent), if that is no fragment or topic itself; a note that comes several ways is kept once, by its best."""
    kinds = category.select("id", "category")
    s = scores.join(kinds.withColumnRenamed("id", "node_id"), "node_id").filter(F.col("category").isNull() | (F.col("category") != "abstract-topic"))
    part = F.coalesce(F.col("category").isin(V.FRAGMENTS), F.lit(False))
    lifted = s.filter(part).join(parents.select(F.col("id").alias("node_id"), "parent"), "node_id").select("query_id", F.col("parent").alias("node_id"), "score")
    lifted = lifted.join(kinds.select(F.col("id").alias("node_id"), F.col("category").alias("_c")), "node_id")
    lifted = lifted.filter(F.col("_c").isNull() | ~F.col("_c").isin("abstract-topic", "atomic-fact", "enriched-fragment")).select("query_id", "node_id", "score")
    every = s.filter(~part).select("query_id", "node_id", "score").unionByName(lifted)
    return every.groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
