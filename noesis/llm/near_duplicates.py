"""Near-duplicate records: pairs whose sets of word sequences have a Jaccard similarity of at least a threshold.

Every record gets a signature of bytes, one per position: position i holds one byte of the smallest hash that any of its
word sequences has under hash function i, so two records agree in a position with the probability of their similarity.
A byte-position inverted index lists the records under each run of ``GROUP`` bytes at its place in the signature; pairs
under one entry are candidates. Count filtering tallies the equal positions of a pair over the last bit of ``TALLIED``
positional bytes and keeps pairs that reach the minimum which a pair at the threshold reaches with all but one in three
million. What is left is verified on the exact sets. There are ``RUNS`` runs, or as many as a pair right at the threshold
needs to meet with a probability of ``RECALL``; more similar pairs meet with more.

Scale: records with the same set are one class, found by a hash aggregate before anything else, so copies, however many,
cost one index entry each and never meet each other. Index entries travel as packed column blobs (6 bytes and a share of
the record's id each) instead of rows; the number of index partitions follows the number of records. Candidates grow with
the square of the records only at the rate similarity**GROUP. An entry of more than ``HOT`` records is not paired where it
is found: its records are cut into chunks, and pairs of chunks are dealt over all tasks.

Result: pairs, smaller id first. Classes are written out as all their pairs. Only in a class of more than ``CLASS_LIMIT``
members, of more than ``CLASS_LIMIT`` records with one and the same text the smallest id stands for the others, which come
as their pairs with it; so no link between different texts is lost, and ``linked_classes`` gives the class, its members
and the number of links of every record.

Defined cases: null, empty and short texts (fewer words than a sequence) have an empty set and no pair; texts of any
length are taken whole; repeated rows of one id are one record, and of several texts under one id one (that of the smallest
hash) is the record's; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noesis.llm.words import WordHashes, mix, shingle_sets
from noesis.session import cut, slots

GROUP = 6
RUNS = 132
RECALL = 0.998
CLASS_LIMIT = 32
HOT = 2_048
ENTRIES_PER_PARTITION = 4_000_000
TALLIED = 384
TALLY_SIGMAS = 5.0


def _salts(n: int) -> np.ndarray:
    """Odd numbers for ``n`` hash functions and one more, the same for every call."""
    return np.random.default_rng(20240229).integers(1, 2**32, n + 1, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def groups_for(threshold: float, recall: float = RECALL) -> int:
    """Byte runs for a pair at the threshold to meet under one of them with the given probability or more."""
    return max(RUNS, int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**GROUP))))


def signature(sets: np.ndarray, sizes: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Bytes [records with a set, positions]."""
    starts = np.concatenate([[0], np.cumsum(sizes[sizes > 0])[:-1]]).astype(np.int64)
    low = (sets >> np.uint64(7)).astype(np.uint32)
    out, salt = np.empty((len(starts), len(positions)), np.uint8), _salts(int(positions.max(initial=0)) + 1)
    for k, p in enumerate(positions):
        least = np.minimum.reduceat((low ^ salt[p]) * salt[p + 1], starts)
        out[:, k] = ((least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def _blocks(b: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def _class_hashes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets, sizes = shingle_sets(b.column(1).to_pylist(), width, hashes)
            has = np.flatnonzero(sizes)
            starts = np.concatenate([[0], np.cumsum(sizes[has])[:-1]]).astype(np.int64)
            h1 = np.bitwise_xor.reduceat(mix(sets), starts) if len(has) else np.zeros(0, np.uint64)
            h2 = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), starts) if len(has) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(has)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["id", "h1", "h2"])

    return run


def _index_blobs(width: int, groups: int, partitions: int):
    positions = np.arange(groups * GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for b in _blocks(whole, 8000):
                sets, sizes = shingle_sets(b.column(1).to_pylist(), width, hashes)
                ids = np.asarray(b.column(0))[sizes > 0].astype(np.int64)
                n = len(ids)
                if not n:
                    continue
                sig = signature(sets, sizes, positions).reshape(n, groups, GROUP).astype(np.uint64)
                key = np.zeros((n, groups), np.uint64)
                for k in range(GROUP):
                    key = (key << np.uint64(8)) | sig[:, :, k]
                key = mix(key | (np.arange(groups, dtype=np.uint64) << np.uint64(48)))
                place = ((key >> np.uint64(40)).astype(np.int64) % partitions).ravel()
                order = np.argsort(place, kind="stable")
                bounds = np.searchsorted(place[order], np.arange(partitions + 1))
                flat, record = key.ravel()[order], (order // groups).astype(np.uint16)
                n_of = np.minimum(sizes[sizes > 0], 65535).astype(np.uint16)
                out = []
                for p in range(partitions):
                    k, r = flat[bounds[p] : bounds[p + 1]], record[bounds[p] : bounds[p + 1]]
                    if len(k):
                        used, local = np.unique(r, return_inverse=True)
                        out.append((p, k.astype(np.uint32).tobytes(), local.astype(np.uint16).tobytes(), ids[used].tobytes(), n_of[used].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32()] + [pa.binary()] * 4)], names=["p", "key", "at", "ids", "n"])

    return run


def _fitting(rec: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Distinct pairs (smaller id, larger id) of entries i and j whose set sizes allow the threshold."""
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    fit = (small >= (threshold - 1e-9) * large) | (small == 65535)
    i, j = i[fit], j[fit]
    a, c = np.minimum(rec[i], rec[j]), np.maximum(rec[i], rec[j])
    return np.unique(np.stack([a, c], 1)[a != c], axis=0)


def _chunks(rec: np.ndarray, n: np.ndarray, hot: int) -> list[bytes]:
    size = hot // 2
    return [rec[k : k + size].tobytes() + n[k : k + size].astype(np.uint16).tobytes() for k in range(0, len(rec), size)]


def _meet(threshold: float, hot: int, block: int = 1_000_000):
    """Pairs of records under one index entry whose set sizes allow the threshold; of hot entries pairs of chunks."""

    def pairs_of(p: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(p), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), none, none], names=["a", "b", "left", "right"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            for p, key, at, ids, n in zip(*(c.to_pylist() for c in b.columns)):
                local = np.frombuffer(at, np.uint16)
                by.setdefault(p, []).append((np.frombuffer(key, np.uint32), np.frombuffer(ids, np.int64)[local], np.frombuffer(n, np.uint16)[local]))
        for parts in by.values():
            key, rec, n = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            order = np.argsort(key, kind="stable")
            key, rec, n = key[order], rec[order], n[order].astype(np.float64)
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            many = np.diff(np.append(begin, len(key)))
            for at, m in zip(begin[many > hot], many[many > hot]):
                chunks = _chunks(rec[at : at + m], n[at : at + m], hot)
                both = [(x, y) for k, x in enumerate(chunks) for y in chunks[k:]]
                for lo in range(0, len(both), 64):
                    some = both[lo : lo + 64]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.array([x for x, _ in some], pa.binary()), pa.array([y for _, y in some], pa.binary())], names=["a", "b", "left", "right"])
            keep = np.repeat((many > 1) & (many <= hot), many)
            key, rec, n = key[keep], rec[keep], n[keep]
            live = np.arange(len(key))
            step = 1
            while True:  # entry i meets entry i + step as long as they are under the same key
                live = live[live + step < len(key)]
                live = live[key[live] == key[live + step]]
                if not len(live):
                    break
                for at in range(0, len(live), block):
                    i = live[at : at + block]
                    p = _fitting(rec, n, i, i + step, threshold)
                    if len(p):
                        yield pairs_of(p)
                step += 1

    return run


def _of_chunks(threshold: float):
    """The pairs of pairs of chunks; other rows pass."""

    def read(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        m = len(raw) // 10
        return np.frombuffer(raw, np.int64, m), np.frombuffer(raw, np.uint16, m, 8 * m).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = b.column(2).is_null()
            yield pa.RecordBatch.from_arrays([b.column(0).filter(plain), b.column(1).filter(plain)], names=["a", "b"])
            for left, right in zip(b.column(2).drop_null().to_pylist(), b.column(3).drop_null().to_pylist()):
                x, y = read(left), read(right)
                rec, n = np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])
                i, j = np.repeat(np.arange(len(x[0])), len(y[0])), np.tile(np.arange(len(x[0]), len(rec)), len(x[0]))
                p = _fitting(rec, n, i, j, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["a", "b"])

    return run


def _tallied(groups: int) -> np.ndarray:
    """The positions whose last bits are tallied: evenly over the signature."""
    return np.unique(np.linspace(0, groups * GROUP - 1, min(TALLIED, groups * GROUP)).astype(int))


def _with_sketch(width: int, groups: int):
    """Texts with the last bits of their tallied positional bytes, packed."""
    positions = _tallied(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for b in _blocks(whole, 4000):
                sets, sizes = shingle_sets(b.column(1).to_pylist(), width, hashes)
                bits = np.packbits(signature(sets, sizes, positions) & 1, axis=1)
                has = pa.array(np.flatnonzero(sizes))
                yield pa.RecordBatch.from_arrays([b.column(0).take(has), b.column(1).take(has), pa.array([r.tobytes() for r in bits], pa.binary())], names=["id", "text", "sketch"])

    return run


def tally_least(positions: int, threshold: float) -> int:
    """Equal bits that a pair at the threshold has at least: positions agree with the probability of the similarity, and
    else their bits do every second time."""
    p = threshold + (1 - threshold) / 2
    return max(1, int(positions * p - TALLY_SIGMAS * (positions * p * (1 - p)) ** 0.5))


def _tally(positions: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sides = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in (2, 3)]
            keep = pa.array(positions - np.bitwise_count(sides[0] ^ sides[1]).sum(1, dtype=np.int64) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return run


def _verify(width: int, threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for f in frames:
            n = len(f)
            sets, sizes = shingle_sets([*f["ta"], *f["tb"]], width, hashes)
            pair = np.repeat(np.concatenate([np.arange(n), np.arange(n)]), sizes)
            order = np.lexsort((sets, pair))
            sets, pair = sets[order], pair[order]
            both = np.bincount(pair[1:][(sets[1:] == sets[:-1]) & (pair[1:] == pair[:-1])], minlength=n)[:n]
            j = both / np.maximum(sizes[:n] + sizes[n:] - both, 1)
            keep = j >= threshold
            yield pd.DataFrame({"a": f["a"][keep], "b": f["b"][keep], "similarity": j[keep]})

    return run


def _classes(df: DataFrame, key: str, text: str, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts with a hash of each, class hashes of every record, classes with their smallest id)."""
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("t"))
    hashed = texts.select(F.struct("id", "t").alias("id"), "text").mapInArrow(_class_hashes(width), "id struct<id:long,t:long>, h1 long, h2 long")
    own = hashed.groupBy("id.id").agg(F.min(F.struct("h1", "h2", F.col("id.t").alias("t"))).alias("m"))
    hashed = cut(own.select("id", "m.h1", "m.h2", "m.t"), "sets")
    classes = hashed.groupBy("h1", "h2").agg(F.min(F.struct("id", "t")).alias("first"), F.count(F.lit(1)).alias("members"))
    return texts, hashed, cut(classes.select(F.col("first.id").alias("rep"), F.col("first.t").alias("t"), "members", "h1", "h2"), "classes")


def _linked(texts: DataFrame, reps: DataFrame, width: int, threshold: float, groups: int, hot: int) -> DataFrame:
    """``a, b, similarity`` of the smallest ids of classes that reach the threshold."""
    records = reps.count()
    own = texts.join(reps.select(F.col("rep").alias("id"), "t"), ["id", "t"], "left_semi").dropDuplicates(["id"]).select("id", "text")
    text_of = cut(own.mapInArrow(_with_sketch(width, groups), "id long, text string, sketch binary"), "texts")
    n = slots(texts.sparkSession)
    partitions = max(n, -(-records * groups // ENTRIES_PER_PARTITION))
    blobs = text_of.select("id", "text").mapInArrow(_index_blobs(width, groups, partitions), "p int, key binary, at binary, ids binary, n binary")
    met = blobs.repartitionById(partitions, F.col("p")).mapInArrow(_meet(threshold, hot), "a long, b long, left binary, right binary")
    met = met.distinct().mapInArrow(_of_chunks(threshold), "a long, b long")
    sketch, tallied = text_of.select("id", "sketch"), len(_tallied(groups))
    sided = met.join(sketch.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    likely = sided.select("a", "b", "sa", "sb").mapInArrow(_tally(tallied, tally_least(tallied, threshold)), "a long, b long")
    both = likely.join(text_of.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(text_of.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    # pairs of hot entries may come several times up to here
    return both.select("a", "b", "ta", "tb").mapInPandas(_verify(width, threshold), "a long, b long, similarity double").distinct()


def near_duplicates(df: DataFrame, key: str, text: str, *, threshold: float = 0.8, width: int = 5, groups: int | None = None, hot: int = HOT) -> DataFrame:
    """``a, b, similarity`` of all pairs of records whose ``width``-word sequence sets reach ``threshold``, smaller id
    first (see the module for classes of exact copies, whose pairs have similarity 1)."""
    texts, hashed, reps = _classes(df, key, text, width)
    linked = _linked(texts, reps, width, threshold, groups or groups_for(threshold), hot)
    copies = hashed.withColumnRenamed("t", "form").join(reps.filter("members > 1").drop("t"), ["h1", "h2"]).select("rep", "id", "members", "form")
    formed = cut(copies.filter(F.col("members") > CLASS_LIMIT), "forms")
    many = formed.groupBy("rep", "form").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > CLASS_LIMIT)
    marked = formed.join(many, ["rep", "form"], "left")
    star = marked.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    small = cut(copies.filter(F.col("members") <= CLASS_LIMIT).select("rep", "id").unionByName(marked.filter("first is null or id = first").select("rep", "id")), "members")
    out = linked
    for side in ("a", "b"):
        member = small.select(F.col("rep").alias(side), F.col("id").alias("member"))
        out = out.join(member, side, "left").withColumn(side, F.coalesce("member", side)).drop("member")
    # a big class is dealt over tasks: one side by hash, the other to every part
    dealt = small.join(small.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / F.lit(CLASS_LIMIT)).cast("long").alias("parts")), "rep")
    one = dealt.select("rep", "id", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    other = dealt.select("rep", F.col("id").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    within = one.join(other, ["rep", "part"]).filter("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    same = within.unionByName(star).withColumn("similarity", F.lit(1.0))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").unionByName(same)


def linked_classes(df: DataFrame, key: str, text: str, *, threshold: float = 0.8, width: int = 5, groups: int | None = None) -> DataFrame:
    """``id, class_id, members, links``: every record with a set, the smallest id of the records with the same set, their
    number, and how many other records it is a near duplicate of."""
    texts, hashed, reps = _classes(df, key, text, width)
    linked = cut(_linked(texts, reps, width, threshold, groups or groups_for(threshold), HOT), "links")
    sized = reps.select(F.col("rep").alias("other"), "members")
    ends = linked.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(linked.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    beyond = ends.join(sized, "other").groupBy("rep").agg(F.sum("members").alias("beyond"))
    every = reps.drop("t").join(beyond, "rep", "left")
    return hashed.join(every, ["h1", "h2"]).select("id", F.col("rep").alias("class_id"), "members", (F.col("members") - 1 + F.coalesce("beyond", F.lit(0))).alias("links"))


def duplicate_classes(df: DataFrame, key: str, text: str, *, width: int = 5) -> DataFrame:
    """``id, class_id, members``: every record with a set and the smallest id of the records with the same set."""
    _, hashed, reps = _classes(df, key, text, width)
    return hashed.join(reps.drop("t"), ["h1", "h2"]).select("id", F.col("rep").alias("class_id"), "members")
