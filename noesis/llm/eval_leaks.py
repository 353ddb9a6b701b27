"""Passages of evaluation items inside a training corpus, found with suffix arrays over the training text.

Words are written as 64-bit hashes. What of the corpus can match at all is cut out first: the hashes of all item windows
of ``least`` words go into a bit table of bounded size (``MOST_BITS``), which every task gets, and the stretches of a
document whose windows hit it become runs. The table lets no match through the net; what it keeps by chance the search
drops. Runs are dealt to shards of about ``SHARD_WORDS`` words; a shard's suffix array, over its suffixes to their full
depth by prefix doubling, is built once with the common lengths of neighbours and written to the shared folder.

Items are dealt to blocks of about ``ITEM_WORDS`` words, and every block meets every shard in a task of its own. There each
item suffix is placed in the array by binary search. Its longest match stands beside that place, and going on from there
the common lengths of neighbours give, at a step each, the longest match with every other suffix that begins with the
same ``least`` words, and where it is. So no text is walked twice and nothing goes through the driver but the bit table.

Defined cases: null and empty texts match nothing; items with fewer than ``least`` words match nothing, or with
``whole_short`` where the whole item stands in a text; documents and items are taken whole; equal items and equal
documents all appear; repeated rows of one id are taken together; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noesis.llm.words import WordHashes, mix, words
from noesis.session import cut

SHARD_WORDS = 500_000
ITEM_WORDS = 500_000
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
CHUNK_BYTES = 1 << 16
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)
SCHEMA = "doc_id long, item_id long, words int, doc_word int, item_word int"


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` words from each position on (positions with fewer left have none)."""
    last = len(codes) - width + 1
    h = np.full(max(last, 0), width, np.uint64)
    for k in range(width if last > 0 else 0):
        h = mix(h + codes[k : last + k] * _FACTORS[k % len(_FACTORS)])
    return h


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        rows = [np.array(hashes.of(words(t)), np.uint64) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([len(r) for r in rows], pa.int32())], names=["item_id", "codes", "size"])


def _bits(bits: int, least: int):
    """Bit tables of the item windows, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, some = np.zeros(bits // 8, np.uint8), False
        for b in batches:
            for raw, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = windows(np.frombuffer(raw, np.uint64), min(n, least)) & np.uint64(bits - 1)
                np.bitwise_or.at(table, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
                some = True
        if some:
            parts = [(k, table[k * CHUNK_BYTES : (k + 1) * CHUNK_BYTES]) for k in range(-(-len(table) // CHUNK_BYTES))]
            parts = [(k, p.tobytes()) for k, p in parts if p.any()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["chunk", "part"])

    return run


def _either(t: pa.Table) -> pa.Table:
    out = np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in t["part"].to_pylist()])
    return pa.table({"chunk": t["chunk"].slice(0, 1), "part": pa.array([out.tobytes()], pa.binary())})


def window_table(items: DataFrame, least: int) -> tuple[np.ndarray, list[int]]:
    """The bit table of all windows of coded items (codes, size), 16 bits a window within bounds, and the window widths."""
    seen = items.agg(F.coalesce(F.sum(F.greatest(F.col("size") - least + 1, F.lit(1))), F.lit(0)).alias("n"), F.collect_set(F.least("size", F.lit(least))).alias("w")).first()
    bits = int(np.clip(1 << int(np.ceil(np.log2(16 * max(seen.n, 1)))), LEAST_BITS, MOST_BITS))
    parts = items.select("codes", "size").mapInArrow(_bits(bits, least), "chunk int, part binary").groupBy("chunk").applyInArrow(_either, "chunk int, part binary").collect()
    table = np.zeros(bits // 8, np.uint8)
    for r in parts:
        table[r.chunk * CHUNK_BYTES : r.chunk * CHUNK_BYTES + len(r.part)] = np.frombuffer(r.part, np.uint8)
    return table, sorted(seen.w)


def _runs(shared, widths: list[int]):
    """Stretches of documents whose windows hit the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHashes(), shared.value
        low = np.uint64(len(table) * 8 - 1)
        for b in batches:
            rows = [hashes.of(words(t)) for t in b.column(1).to_pylist()]
            sizes = np.array([len(r) for r in rows], np.int64)
            codes = np.fromiter((c for r in rows for c in r), np.uint64, int(sizes.sum()))
            owner, cover = np.repeat(np.arange(len(rows)), sizes), np.zeros(len(codes) + 1, np.int64)
            for w in widths:
                h = windows(codes, w) & low
                at = np.flatnonzero((table[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1)
                at = at[owner[at] == owner[at + w - 1]] if len(at) else at
                np.add.at(cover, at, 1)
                np.add.at(cover, at + w, -1)
            inside = np.cumsum(cover)[:-1] > 0
            fresh = np.ones(len(codes), bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
            starts = np.flatnonzero(fresh)
            ends = np.append(starts[1:], len(codes)) if len(starts) else starts
            keep = inside[starts] if len(starts) else np.zeros(0, bool)
            starts, ends = starts[keep], ends[keep]
            doc, begin = owner[starts], np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array((starts - begin[doc]).astype(np.int32)), pa.array([codes[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()), pa.array((ends - starts).astype(np.int32))],
                names=["doc_id", "first", "codes", "size"],
            )

    return run


def suffix_array(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``seq`` in the order of their suffixes, by prefix doubling to full depth, and how many places each shares
    with the suffix before it. Every value that ends a text must be unlike all others."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    levels, have = [rank.astype(np.int32)], 1
    while have < n and rank.max(initial=0) < n - 1:
        ahead = np.zeros(n, np.int64)
        ahead[: n - have] = rank[have:] + 1
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        levels.append(rank.astype(np.int32))
        have *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = np.zeros(len(a), bool)
        fit = (a < n) & (b < n)
        same[fit] = levels[k][a[fit]] == levels[k][b[fit]]
        step = same * (1 << k)
        a, b = a + step, b + step
        common[1:] += step
    return order, common


def _build(t: pa.Table) -> pa.Table:
    """The suffix array of a shard: words become even numbers in the order of their hashes, ends of runs numbers below."""
    runs = [np.frombuffer(c, np.uint64) for c in t["codes"].to_pylist()]
    sizes = np.array([len(r) for r in runs], np.int64)
    vocabulary, code = np.unique(np.concatenate(runs), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    seq = np.empty(int(sizes.sum()) + len(runs), np.int64)
    ends = begin + sizes
    seq[ends] = np.arange(len(runs)) - len(runs) - 1
    word = np.ones(len(seq), bool)
    word[ends] = False
    seq[word] = 2 * code
    order, common = suffix_array(seq)
    blob = lambda x, kind: pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())
    docs, first = np.asarray(t["doc_id"].combine_chunks()), np.asarray(t["first"].combine_chunks())
    return pa.table({
        "shard": t["shard"].slice(0, 1), "vocabulary": blob(vocabulary, np.uint64), "seq": blob(seq, np.int64), "array": blob(order, np.int32), "common": blob(common, np.int32),
        "begin": blob(begin, np.int64), "doc": blob(docs, np.int64), "first": blob(first, np.int32),
    })


_ARRAYS = "shard int, vocabulary binary, seq binary, array binary, common binary, begin binary, doc binary, first binary"


def _alike(seq: np.ndarray, at: np.ndarray, item: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many places the two suffixes share; both sequences end in values the other has not."""
    out, live = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(live):
        live = live[seq[at[live] + out[live]] == item[q[live] + out[live]]]
        out[live] += 1
    return out


def _placed(seq: np.ndarray, array: np.ndarray, item: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Where each item suffix would stand in the array."""
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(array), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        at = array[mid]
        n = _alike(seq, at, item, q[open_])
        right = seq[at + n] < item[q[open_] + n]
        lo[open_[right]], hi[open_[~right]] = mid[right] + 1, mid[~right]
    return lo


def matches(seq: np.ndarray, array: np.ndarray, common: np.ndarray, item: np.ndarray, q: np.ndarray, least: int, block: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item suffix, place in seq, words) of all matches of at least ``least`` words of the item suffixes ``q``."""
    place = _placed(seq, array, item, q)
    before, behind = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    some = np.flatnonzero(place > 0)
    before[some] = _alike(seq, array[place[some] - 1], item, q[some])
    some = np.flatnonzero(place < len(array))
    behind[some] = _alike(seq, array[place[some]], item, q[some])
    starts = np.flatnonzero(np.append(common < least, True))  # the array falls into groups that share their first words
    for step, n in ((1, behind), (-1, before)):
        hit = np.flatnonzero(n >= least)
        at = place[hit] if step > 0 else place[hit] - 1
        group = np.searchsorted(starts, at, "right")
        many = starts[group] - at if step > 0 else at - starts[group - 1] + 1
        cum = np.cumsum(many)
        lo = 0
        while lo < len(hit):
            hi = max(lo + 1, int(np.searchsorted(cum, (cum[lo - 1] if lo else 0) + block, "right")))
            m = many[lo:hi]
            seg = np.repeat(np.arange(hi - lo), m)
            off = np.arange(len(seg)) - np.repeat(np.cumsum(m) - m, m)
            k = at[lo:hi][seg] + step * off
            v = np.where(off == 0, n[hit[lo:hi]][seg], common[np.minimum(k + (step < 0), len(common) - 1)])
            lift = (hi - lo - seg) * (int(v.max()) + 1)  # later groups lie below earlier ones, so a running least starts anew
            yield hit[lo:hi][seg], array[k], np.minimum.accumulate(v + lift) - lift
            lo = hi


def _longest(rows: np.ndarray) -> np.ndarray:
    """Of the rows (doc, item, words, doc word, item word) the longest, then first, of each document and item."""
    rows = rows[np.lexsort((rows[:, 4], rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[first]


def _search(least: int):
    def run(shard: pa.Table, items: pa.Table) -> pa.Table:
        empty = np.zeros((0, 5), np.int64)
        best = empty
        if shard.num_rows and items.num_rows:
            get = lambda c, kind: np.frombuffer(shard[c][0].as_py(), kind)
            vocabulary, seq, array, common = get("vocabulary", np.uint64), get("seq", np.int64), get("array", np.int32).astype(np.int64), get("common", np.int32).astype(np.int64)
            begin, doc, first = get("begin", np.int64), get("doc", np.int64), get("first", np.int32)
            raw = [np.frombuffer(c, np.uint64) for c in items["codes"].to_pylist()]
            sizes = np.array([len(r) for r in raw], np.int64)
            flat = np.concatenate(raw)
            place = np.searchsorted(vocabulary, flat)
            known = vocabulary[np.minimum(place, len(vocabulary) - 1)] == flat
            start = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
            item = np.full(len(flat) + len(raw), -1, np.int64)
            word = np.ones(len(item), bool)
            word[start + sizes] = False
            item[word] = np.where(known, 2 * place, 2 * place - 1)
            ids = np.asarray(items["item_id"].combine_chunks())
            need = np.minimum(sizes, least)
            for width in np.unique(need):
                who = np.flatnonzero(need == width)
                owner = np.repeat(who, sizes[who] - width + 1)
                offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[who] - width + 1) - (sizes[who] - width + 1), sizes[who] - width + 1)
                for suffix, pos, n in matches(seq, array, common, item, start[owner] + offset, int(width)):
                    r = np.searchsorted(begin, pos, "right") - 1
                    rows = np.stack([doc[r], ids[owner[suffix]], n, first[r] + pos - begin[r], offset[suffix]], 1)
                    best = _longest(np.concatenate([best, _longest(rows)]))
        names = ["doc_id", "item_id", "words", "doc_word", "item_word"]
        return pa.table({c: pa.array(best[:, k].astype(np.int64 if k < 2 else np.int32)) for k, c in enumerate(names)})

    return run


def eval_leaks(documents: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = 10, whole_short: bool = False, shard_words: int = SHARD_WORDS, item_words: int = ITEM_WORDS) -> DataFrame:
    """``doc_id, item_id, words, doc_word, item_word``: for each document and item with a verbatim passage of at least
    ``least`` words in common, the longest (then the first) one: its words, and the word numbers, from 0, where it begins
    in both. With ``whole_short`` an item of fewer words counts where all of it stands in a text."""
    spark = documents.sparkSession
    coded = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(_coded, "item_id long, codes binary, size int")
    coded = cut(coded.filter(F.col("size") >= (1 if whole_short else least)).distinct(), "items")
    table, widths = window_table(coded, least)
    if not widths:
        return spark.createDataFrame([], SCHEMA)
    docs = documents.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).filter(F.length("text") >= 2 * min(widths) - 1)
    runs = cut(docs.mapInArrow(_runs(spark.sparkContext.broadcast(table), widths), "doc_id long, first int, codes binary, size int"), "runs")
    words_in = lambda df: int(df.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    shards, blocks = -(-words_in(runs) // shard_words), -(-words_in(coded) // item_words)
    if not shards:
        return spark.createDataFrame([], SCHEMA)
    dealt = runs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "first"), F.lit(shards)).cast("int"))
    arrays = cut(dealt.groupBy("shard").applyInArrow(_build, _ARRAYS), "suffix-arrays")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = arrays.withColumn("block", all_of(blocks))
    right = coded.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).withColumn("shard", all_of(shards))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(least), SCHEMA)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("words")).alias("w"), "doc_word", "item_word")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.w")).alias("words"), "b.doc_word", "b.item_word")


def without_leaks(documents: DataFrame, leaks: DataFrame, *, doc_key: str = "doc_id") -> DataFrame:
    """The documents that give nothing away. Affected keys are distinct keys of the corpus: a shuffle anti-join, left to
    AQE to broadcast when small."""
    return documents.join(leaks.select(F.col("doc_id").alias(doc_key)).distinct(), doc_key, "left_anti")
