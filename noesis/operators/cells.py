"""Cells around centroids: where vectors meet that may be similar.

Vectors are normalised. Centroids are fitted on at most ``SAMPLE`` vectors, chosen by hash of the id; every vector is placed.
The number of cells follows the number of vectors without end: beyond ``COARSE`` centroids each of their cells is split by
residual centroids fitted on the pooled residuals of the sample, so a cell's size and the work per vector stay the same at
any scale. A vector is kept in its ``keep`` nearest cells and asks the ``probe`` nearest; two vectors meet in a cell that one
asks and the other is kept in. A cell that grows dense all the same is dealt into parts, and each part of its asking vectors
meets each part of its members in a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noesis.operators.sampling import bounded_sample
from noesis.session import cut, slots

SAMPLE = 16_384
CELL = 1_024
COARSE = 4_096
DENSE = 16_384
ROWS_PER_TASK = 12_000
BLOCK = 1_024
KEEPS, ASKS = 2, 1


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable (``dim`` finite numbers, not all zero), and their normalised vectors."""
    n = len(column)
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    fit = sizes == dim
    flat = column.filter(pa.array(fit)).flatten()
    v = np.asarray(flat.fill_null(np.nan) if flat.null_count else flat, np.float64).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.linalg.norm(v, axis=1)
    good = np.isfinite(v).all(1) & (length > 0) & np.isfinite(length)
    usable = np.zeros(n, bool)
    usable[np.flatnonzero(fit)[good]] = True
    return usable, v[good] / length[good, None]


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """Spherical k-means from evenly drawn rows of ``x`` (rows are in hash order, which is random)."""
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        order = np.argsort(near, kind="stable")
        filled, starts = np.unique(near[order], return_index=True)
        c[filled] = np.add.reduceat(x[order], starts, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Cells:
    """Cells around coarse centroids, each split by the residual centroids they share."""

    def __init__(self, coarse: np.ndarray, fine: np.ndarray) -> None:
        self.coarse, self.fine = coarse, fine
        self.count = len(coarse) * len(fine)

    @classmethod
    def fit(cls, x: np.ndarray, wanted: int, coarse: int = COARSE) -> Cells:
        """Cells for about ``wanted`` cells; four sampled vectors or more stand behind a centroid."""
        most = max(1, len(x) // 4)
        c = fit_centroids(x, max(1, min(coarse, most, wanted)))
        split = max(1, min(most, -(-wanted // len(c))))
        if split == 1:
            return cls(c, np.zeros((1, x.shape[1]), np.float32))
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        rest = x - c[near]
        f = rest[np.linspace(0, len(rest) - 1, split).astype(int)].copy()
        for _ in range(5):
            own = np.concatenate([(rest[i : i + 2048] @ f.T - (f**2).sum(1) / 2).argmax(1) for i in range(0, len(rest), 2048)])
            order = np.argsort(own, kind="stable")
            filled, starts = np.unique(own[order], return_index=True)
            f[filled] = np.add.reduceat(rest[order], starts, axis=0) / np.bincount(own, minlength=split)[filled, None]
        return cls(c, f)

    def nearest(self, v: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each row, nearest first."""
        score = v @ self.coarse.T
        if len(self.fine) == 1:
            n = min(n, self.count)
            best = np.argpartition(-score, n - 1, axis=1)[:, :n]
            return np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1), 1)
        wide = min(n + 2, len(self.coarse))
        top = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
        inner, size = v @ self.fine.T, (self.fine**2).sum(1)
        cross = self.coarse @ self.fine.T
        # |v - c - f|^2 without what is the same for all: -2 v.c - 2 v.f + 2 c.f + |f|^2
        far = -2 * np.take_along_axis(score, top, 1)[:, :, None] - 2 * inner[:, None, :] + 2 * cross[top] + size
        far, n = far.reshape(len(v), -1), min(n, wide * len(self.fine))
        best = np.argpartition(far, n - 1, axis=1)[:, :n]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(far, best, 1), axis=1), 1)
        return np.take_along_axis(top, best // len(self.fine), 1) * len(self.fine) + best % len(self.fine)

    def places(self, v: np.ndarray, asks: np.ndarray, keep: int, probe: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, role) of every cell a row is kept in or asks."""
        near = self.nearest(v, max(keep, probe))
        rank = np.arange(near.shape[1])[None, :]
        role = np.where(rank < keep, KEEPS, 0) + np.where((rank < probe) & asks[:, None], ASKS, 0)
        row, col = np.nonzero(role)
        return row, near[row, col], role[row, col]


def sample_vectors(df: DataFrame, dim: int, rows: int = SAMPLE) -> np.ndarray:
    """Normalised usable vectors (id, v) of at most ``rows`` records, in the order of a hash of their id."""
    few = bounded_sample(df.filter(F.size("v") == dim), ["id"], rows)
    t = few.select("v").toArrow()
    return unit_rows(t.column(0).combine_chunks(), dim)[1].astype(np.float32) if t.num_rows else np.zeros((0, dim), np.float32)


def direction_classes(df: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(id and direction hash of every usable row of (id, v); classes of one direction, to five decimals, with their
    smallest id, members and rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for b in batches:
            usable, v = unit_rows(b.column(1), dim)
            rounded = np.round(v * 1e5).astype(np.int32)
            raw = np.frombuffer(b"".join(blake2b(r.tobytes(), digest_size=16).digest() for r in rounded), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(usable)), pa.array(raw[:, 0].copy()), pa.array(raw[:, 1].copy())], names=["id", "h1", "h2"])

    hashed = cut(df.select("id", "v").mapInArrow(run, "id long, h1 long, h2 long"), "directions")
    classes = hashed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("members"), F.count(F.lit(1)).alias("rows"))
    return hashed, cut(classes, "direction-classes")


def _sizes(dim: int, cells: Cells, keep: int, probe: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                usable, v = unit_rows(b.column(1), dim)
                if len(v):
                    cell, n = np.unique(cells.places(v.astype(np.float32), np.asarray(b.column(2))[usable], keep, probe)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(n.astype(np.int64))], names=["cell", "n"])

    return run


def _place(dim: int, cells: Cells, keep: int, probe: int, extra: Callable[[np.ndarray], np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                usable, v = unit_rows(b.column(1), dim)
                if not len(v):
                    continue
                v = v.astype(np.float32)
                mark = b.column(3).filter(pa.array(usable))
                row, cell, role = cells.places(v, np.asarray(b.column(2))[usable], keep, probe)
                raw = [r.tobytes() for r in v]
                more = [r.tobytes() for r in extra(v)] if extra else [None] * len(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int64)), b.column(0).filter(pa.array(usable)).take(pa.array(row)), pa.array([raw[i] for i in row], pa.binary()), pa.array([more[i] for i in row], pa.binary()), pa.array(role.astype(np.int32)), mark.take(pa.array(row))],
                    names=["cell", "id", "v", "extra", "role", "mark"],
                )

    return run


def _dealt(placed: DataFrame, sizes: DataFrame, dense: int) -> DataFrame:
    """Rows of dense cells by part: each part of the asking rows beside each part of the kept ones. The table of dense
    cells is joined, and broadcast only if Spark finds it small."""
    parts = sizes.filter(F.col("n") > dense).select("cell", F.ceil(F.col("n") / dense).cast("int").alias("parts"))
    p = placed.join(parts, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    p = p.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    pair = lambda ask, keep, role: F.struct(ask.cast("int").alias("ask"), keep.cast("int").alias("keep"), role.cast("int").alias("role"))
    asks, keeps = F.col("role").bitwiseAND(ASKS), F.col("role").bitwiseAND(KEEPS)
    asked = F.transform(every, lambda m: pair(F.col("part"), m, asks + F.when(m == F.col("part"), keeps).otherwise(0)))
    kept = F.transform(F.filter(every, lambda m: m != F.col("part")), lambda m: pair(m, F.col("part"), keeps))
    places = F.when(F.col("parts") == 1, F.array(pair(F.lit(0), F.lit(0), F.col("role")))).otherwise(F.filter(F.concat(asked, kept), lambda x: x["role"] > 0))
    return p.withColumn("place", F.explode(places)).select("cell", "place.ask", "place.keep", "id", "v", "extra", "place.role", "mark")


def meet(df: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str, *, dim: int, cells: Cells, total: int, keep: int, probe: int, dense: int = DENSE, extra: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Results of ``work`` on the rows (id, v as bytes of float32, extra, role, mark) of every cell, or pair of parts of a dense
    cell. ``df`` has id, v, asks (boolean) and mark (boolean)."""
    rows = df.select("id", "v", "asks", "mark")
    sizes = cut(rows.mapInArrow(_sizes(dim, cells, keep, probe), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cell-sizes")
    placed = rows.mapInArrow(_place(dim, cells, keep, probe, extra), "cell long, id long, v binary, extra binary, role int, mark boolean")
    placed = _dealt(placed, sizes, dense)
    placed = placed.repartition(max(slots(df.sparkSession), total * max(keep, probe) // ROWS_PER_TASK), "cell", "ask", "keep")
    return placed.groupBy("cell", "ask", "keep").applyInArrow(work, schema)
