"""The k most similar vectors of every vector, by cosine, out of the whole collection.

Vectors are normalised, which makes the cosine an inner product, and indexed in cells around centroids; every vector is
kept in its ``SPILL`` nearest cells and asks ``probe`` of them, so two vectors meet if they share any. A vector is cut into
subspaces of ``SUBSPACE`` numbers, each written as one of 16 codewords. Codes are score-aware: with anisotropic loss the
part of the residual parallel to the vector, which moves high inner products, costs ``eta`` times the orthogonal part, both
when codewords are fitted and when codes are chosen. In a cell every asking vector makes a table of its inner products with
the codewords, quantised to bytes; the scan looks the packed four-bit codes of all members up in it and adds, and the
``RERANK`` best of a cell are ranked exactly on the full vectors. These travel with their cell: fetching them for survivors
only would move a row for each of the 24 survivors of every vector and cell, more bytes than the vector itself.

What is fitted (centroids, codewords) is fitted on at most ``cells.SAMPLE`` vectors, chosen by hash of the id; every vector is
indexed and asks. The number of cells follows the number of vectors without end: beyond ``cells.COARSE`` centroids each of their
cells is split by residual centroids fitted on the pooled residuals of the sample, so a cell's size and the work per vector
stay the same at any scale. A cell that grows dense all the same is dealt into parts, and each part of its asking vectors
meets each part of its members in a task of its own. Vectors of the same direction (to five decimals) are one class with one
index entry, however many; their members are answered from the class.

Defined cases: a vector that is null, of another length, all zero, or holds a null, NaN or infinity is not usable and
appears nowhere; ties are broken by the smaller id; repeated rows of one id are one; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noesis.operators import cells as C
from noesis.session import cut

SPILL = 3
SUBSPACE = 4
CODEWORDS = 16
FIT_CODES = 4_096
RERANK = 24


def anisotropic_weight(dim: int, threshold: float = 0.2) -> float:
    """Cost of parallel against orthogonal residual when inner products of at least ``threshold`` matter."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


class Codebook:
    """Codewords of every subspace under anisotropic loss."""

    def __init__(self, words: np.ndarray, eta: float) -> None:
        self.words, self.eta = words, eta  # [subspaces, codewords, SUBSPACE]

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes [rows, subspaces] by coordinate descent: each subspace in turn takes the word with the least
        |r|^2 + (eta - 1) (r . x)^2, the other subspaces held."""
        parts = x.reshape(len(x), -1, SUBSPACE)
        subs = parts.shape[1]
        dots = np.einsum("nsd,skd->nsk", parts, self.words, optimize=True)
        own = (parts**2).sum(2)
        dist = own[:, :, None] - 2 * dots + (self.words**2).sum(2)[None]
        along = own[:, :, None] - dots  # residual . x, per subspace and word
        codes = dist.argmin(2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(rounds):
            for s in range(subs):
                rest = total - along[rows, s, codes[:, s]]
                codes[:, s] = (dist[:, s] + (self.eta - 1) * (rest[:, None] + along[:, s]) ** 2).argmin(1)
                total = rest + along[rows, s, codes[:, s]]
        return codes.astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.words[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)

    def scan(self, q: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Rough scores [rows of packed codes, queries], in units of their own for each query: the tables of both codes of a
        byte are added to one of 256 entries, looked up byte by byte and summed."""
        dots = np.einsum("qsd,skd->skq", q.reshape(len(q), -1, SUBSPACE), self.words, optimize=True)
        dots -= dots.min(1, keepdims=True)
        table = np.round(dots * (255 / np.maximum(dots.max((0, 1)), 1e-12))).astype(np.uint16)
        both = (table[0::2, :, None] + table[1::2, None]).reshape(len(table) // 2, 256, len(q))
        out = both[0].take(packed[:, 0], axis=0)
        for k in range(1, len(both)):
            out += both[k].take(packed[:, k], axis=0)
        return out

    @classmethod
    def fit(cls, x: np.ndarray, eta: float, rounds: int = 4) -> Codebook:
        subs = x.shape[1] // SUBSPACE
        parts = x.reshape(len(x), subs, SUBSPACE)
        pick = np.linspace(0, len(x) - 1, CODEWORDS).astype(int)
        book = cls(parts[pick].transpose(1, 0, 2).copy(), eta)
        for _ in range(rounds):
            codes = book.encode(x, 1)
            along = ((parts - book.decode(codes).reshape(parts.shape)) * parts).sum(2)
            rest = along.sum(1, keepdims=True) - along
            for s in range(subs):
                for k in range(CODEWORDS):
                    m = codes[:, s] == k
                    if m.any():
                        u = parts[m, s]
                        # least squares of |u - c|^2 + (eta - 1) (rest + (u - c) . u)^2 in c
                        left = m.sum() * np.eye(SUBSPACE) + (eta - 1) * u.T @ u
                        right = u.sum(0) + (eta - 1) * u.T @ (rest[m, s] + (u**2).sum(1))
                        book.words[s, k] = np.linalg.solve(left, right)
        return book


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    return (codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8)


def unpack(packed: np.ndarray) -> np.ndarray:
    out = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    out[:, 0::2], out[:, 1::2] = packed >> 4, packed & 15
    return out


def _in_cell(dim: int, book: Codebook, k: int, least: float, rerank: int):
    def run(t: pa.Table) -> pa.Table:
        role = np.asarray(t.column("role").combine_chunks())
        ids = np.asarray(t.column("id").combine_chunks())
        v = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float32).reshape(-1, dim)
        asking, kept = np.flatnonzero(role & C.ASKS), np.flatnonzero(role & C.KEEPS)
        codes = np.frombuffer(b"".join(t.column("extra").to_pylist()), np.uint8).reshape(len(ids), -1)[kept]
        n, a, b, c = len(kept), [], [], []
        own = np.full(len(ids), -1)
        own[kept] = np.arange(n)
        keep = min(rerank, n)
        for at in range(0, len(asking) if n else 0, C.BLOCK):
            row = asking[at : at + C.BLOCK]
            q = v[row]
            rough = book.scan(q, codes).T.astype(np.int32)
            self_at = own[row]
            rough[np.flatnonzero(self_at >= 0), self_at[self_at >= 0]] = -1
            best = kept[np.argpartition(-rough, keep - 1, axis=1)[:, :keep]]
            exact = np.einsum("qd,qkd->qk", q.astype(np.float64), v[best].astype(np.float64), optimize=True)
            exact[ids[best] == ids[row][:, None]] = -9
            order = np.lexsort((ids[best], -exact), axis=1)[:, :k]
            best, exact = np.take_along_axis(best, order, 1), np.take_along_axis(exact, order, 1)
            i, j = np.nonzero(exact >= least)
            a.append(ids[row[i]]), b.append(ids[best[i, j]]), c.append(exact[i, j])
        cat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0, kind))
        return pa.table({"a": cat(a, np.int64), "b": cat(b, np.int64), "cosine": cat(c, np.float64)})

    return run


def nearest_vectors(df: DataFrame, key: str, vector: str, *, k: int = 5, dim: int = 128, least: float = 0.8, spill: int = SPILL, asking: Column | None = None, probe: int | None = None, rerank: int = RERANK, cell: int = C.CELL, coarse: int = C.COARSE, dense: int = C.DENSE) -> DataFrame:
    """``a, b, cosine, place``: for every usable vector ``a`` its at most ``k`` most similar others ``b`` with a cosine of
    at least ``least``, place from 1. With ``asking`` (a condition on the rows of ``df``) only these vectors ask, ``probe``
    cells each, all being kept in ``spill``. ``rerank`` of a cell are ranked exactly; far neighbours, whose cosines lie close
    together, need more of both."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(F.lit(True) if asking is None else asking, F.lit(False)).alias("asks"))
    hashed, reps = C.direction_classes(rows, dim)
    count = reps.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("rows") > 1, 1)), F.lit(0))).first()
    total, repeated = int(count[0]), int(count[1])
    empty = spark.createDataFrame([], "a long, b long, cosine double, place int")
    if total == 0:
        return empty
    sample = C.sample_vectors(rows.select("id", "v"), dim)
    cells = C.Cells.fit(sample, max(1, total // cell), coarse)
    book = Codebook.fit(sample[:: max(1, len(sample) // FIT_CODES)].astype(np.float64), anisotropic_weight(dim))
    probe = probe or spill
    # rows that repeat a direction leave before vectors are copied to cells; the table of those rows holds ids only
    spare = hashed.join(reps.filter("rows > 1"), ["h1", "h2"]).select("id", "rep", "members")
    own = rows
    if repeated:
        own = rows.join(spare.filter("id <> rep").select("id"), "id", "left_anti")
        if asking is not None:  # a class asks if any of its members does
            asks = rows.filter("asks").join(spare, "id").select(F.col("rep").alias("id"), F.lit(True).alias("one")).distinct()
            own = own.join(asks, "id", "left").select("id", "v", (F.col("asks") | F.coalesce("one", F.lit(False))).alias("asks"))
    near = C.meet(
        own.withColumn("mark", F.lit(False)), _in_cell(dim, book, k, least, rerank), "a long, b long, cosine double", dim=dim, cells=cells, total=total, keep=spill, probe=probe, dense=dense, extra=lambda v: pack(book.encode(v))
    )
    near = near.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    first = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    near = near.filter("a <> b").withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
    if not repeated:
        return near
    near = cut(near, "near-classes")
    # Each class answers with its smallest k + 1 ids: enough for any member's k nearest.
    member = spare.distinct()
    head = (
        member.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("n") <= k + 1)
        .groupBy("rep").agg(F.collect_list("id").alias("heads"))
    )
    side = near.join(member.select(F.col("rep").alias("a"), F.col("id").alias("from")), "a", "left").withColumn("from", F.coalesce("from", "a"))
    side = side.join(head.withColumnRenamed("rep", "b"), "b", "left").withColumn("to", F.explode(F.coalesce("heads", F.array("b"))))
    others = side.select(F.col("from").alias("a"), F.col("to").alias("b"), "cosine")
    siblings = member.join(head, "rep").select(F.col("id").alias("a"), F.explode("heads").alias("b"), F.lit(1.0).alias("cosine")).filter("a <> b")
    out = others.unionByName(siblings)
    if asking is not None:
        out = out.join(rows.filter("asks").select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    return out.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
