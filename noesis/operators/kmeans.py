"""k-means with many centroids: rows meet all centroids as matrices in tasks; sums of a centroid are added up where it is dealt to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noesis.operators.cells import unit_rows
from noesis.session import cut, slots

#: Numbers of one product of rows with centroids.
PRODUCT = 8_000_000


def _near(v: np.ndarray, c: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (the first on ties), and the squared distance; ``half`` is half the squared lengths."""
    at, score = np.zeros(len(v), np.int64), np.zeros(len(v), np.float32)
    step = max(16, PRODUCT // len(c))
    for i in range(0, len(v), step):
        s = v[i : i + step] @ c.T
        s -= half
        at[i : i + step] = s.argmax(1)
        score[i : i + step] = s[np.arange(len(s)), at[i : i + step]]
    return at, np.maximum((v.astype(np.float64) ** 2).sum(1) - 2.0 * score, 0.0)


def _half(c: np.ndarray) -> np.ndarray:
    return ((c.astype(np.float64) ** 2).sum(1) / 2).astype(np.float32)


def _rows(b: pa.RecordBatch, dim: int) -> tuple[pa.Array, np.ndarray]:
    return b.column(0), np.asarray(b.column(1).flatten()).reshape(-1, dim)


def _reduced(x: np.ndarray, weight: np.ndarray, k: int, seed: int, rounds: int = 5) -> np.ndarray:
    """``k`` of the weighted candidates by k-means++, then some rounds of weighted k-means on them."""
    if len(x) <= k:
        return x
    r, size = np.random.default_rng(seed), (x.astype(np.float64) ** 2).sum(1)
    chosen = [int(r.choice(len(x), p=weight / weight.sum()))]
    far = np.full(len(x), np.inf)
    while len(chosen) < k:
        far = np.minimum(far, np.maximum(size + size[chosen[-1]] - 2.0 * (x @ x[chosen[-1]]), 0.0))
        far[chosen[-1]] = 0.0
        p = np.cumsum(far * weight)
        if p[-1] <= 0:
            break
        chosen.append(int(np.searchsorted(p, r.random() * p[-1], side="right")))
    c = x[chosen].copy()
    for _ in range(rounds):
        near = _near(x, c, _half(c))[0]
        order = np.argsort(near, kind="stable")
        filled, starts = np.unique(near[order], return_index=True)
        c[filled] = np.add.reduceat(x[order] * weight[order, None], starts, axis=0) / np.add.reduceat(weight[order], starts)[:, None]
    return c


def fit(notes: DataFrame, k: int, *, dim: int = 128, seed: int = 42, rounds: int = 10, steps: int = 2, tolerance: float = 1e-4) -> DataFrame:
    """``id, topic`` of notes (id, embedding) by k-means on unit vectors, the same for any partitioning up to the order of sums.

    Candidates are drawn in ``steps`` passes, each about 2 ``k`` by their squared distance to those before, and reduced to
    ``k`` by the rows they stand for (k-means||). Then at most ``rounds`` rounds; a centroid without rows stays."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            usable, v = unit_rows(b.column(1), dim)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dim, pa.int32()), pa.array(v.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(usable)), flat], names=["id", "v"])

    rows = cut(notes.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(units, "id long, v array<float>"), "unit-rows")
    vectors = lambda df: np.asarray(df.toArrow()["v"].combine_chunks().flatten(), np.float32).reshape(-1, dim)
    c = vectors(rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).select("v"))
    if not len(c):
        return rows.select("id", F.lit(0).alias("topic"))

    def near(c: np.ndarray) -> DataFrame:
        half = _half(c)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, v = _rows(b, dim)
                at, far = _near(v, c, half)
                yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(far), b.column(1)], names=["id", "topic", "far", "v"])

        return rows.mapInArrow(run, "id long, topic int, far double, v array<float>")

    for step in range(steps):
        far = cut(near(c).select("id", "far"), "distances")
        total = far.agg(F.sum("far")).first()[0]
        if not total:
            break
        drawn = (F.pmod(F.xxhash64("id", F.lit(seed + 1 + step)), F.lit(1 << 40)) / float(1 << 40)) * total < F.col("far") * (2.0 * k)
        c = np.concatenate([c, vectors(rows.join(far.filter(drawn).select("id"), "id", "left_semi").orderBy("id").select("v"))])
    if len(c) > k:
        weight = np.zeros(len(c))
        for topic, n in near(c).groupBy("topic").agg(F.count(F.lit(1))).collect():
            weight[topic] = n
        c = _reduced(c, weight, k, seed)

    def sums(c: np.ndarray):
        half = _half(c)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(c.shape), np.zeros(len(c), np.int64)
            for b in batches:
                v = _rows(b, dim)[1]
                at = _near(v, c, half)[0]
                order = np.argsort(at, kind="stable")
                filled, starts = np.unique(at[order], return_index=True)
                if len(filled):
                    total[filled] += np.add.reduceat(v[order].astype(np.float64), starts, axis=0)
                    n += np.bincount(at, minlength=len(c))
            yield table(np.flatnonzero(n), n, total)

        return run

    def table(topics: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(topics) + 1) * dim, pa.int32()), pa.array(total[topics].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(topics.astype(np.int32)), pa.array(n[topics]), flat], names=["topic", "n", "total"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, pa.schema([("topic", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))])).combine_chunks()
        if t.num_rows:
            topics, at = np.unique(np.asarray(t["topic"]), return_inverse=True)
            total, n = np.zeros((len(topics), dim)), np.bincount(at, np.asarray(t["n"])).astype(np.int64)
            np.add.at(total, at, np.asarray(t["total"].combine_chunks().flatten()).reshape(-1, dim))
            yield table(np.arange(len(topics)), n, total).set_column(0, "topic", pa.array(topics.astype(np.int32)))

    schema = "topic int, n long, total array<double>"
    for _ in range(rounds):
        got = rows.mapInArrow(sums(c), schema).repartition(slots(rows.sparkSession), "topic").mapInArrow(added, schema).toArrow().combine_chunks()
        new = c.copy()
        new[np.asarray(got["topic"])] = (np.asarray(got["total"].combine_chunks().flatten()).reshape(-1, dim) / np.asarray(got["n"])[:, None]).astype(np.float32)
        moved = float(((new - c) ** 2).sum(1).max())
        c = new
        if moved <= tolerance**2:
            break
    return near(c).select("id", "topic")
