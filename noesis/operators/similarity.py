"""Similarity joins on vectors: candidates meet in cells, similarities are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noesis.functions import vectors
from noesis.operators import cells as C
from noesis.session import cut

#: Cells a vector asks, by the least similarity looked for: less similar vectors lie in farther cells.
PROBES = ((0.8, 4), (0.65, 12), (0.0, 32))
CLASS_PART = 64


def _products(dim: int, least: float, sides: bool):
    def run(t: pa.Table) -> pa.Table:
        role, ids = (np.asarray(t.column(c).combine_chunks()) for c in ("role", "id"))
        v = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)
        side = np.asarray(t.column("mark").combine_chunks().fill_null(False))
        asking, kept = np.flatnonzero(role & C.ASKS), np.flatnonzero(role & C.KEEPS)
        a, b, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for at in range(0, len(asking) if len(kept) else 0, C.BLOCK):
            row = asking[at : at + C.BLOCK]
            s = v[row] @ v[kept].T
            i, j = np.nonzero(s >= least - 1e-6)
            x, y = row[i], kept[j]
            fit = (ids[x] != ids[y]) & ((side[x] != side[y]) if sides else True)
            x, y, s = x[fit], y[fit], s[i, j][fit]
            a.append(np.minimum(ids[x], ids[y])), b.append(np.maximum(ids[x], ids[y])), c.append(s)
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "similarity": np.concatenate(c)})

    return run


def _exact(least: float):
    def run(batches):
        for t in batches:
            x, y = (np.asarray(t.column(k).flatten(), np.float64).reshape(t.num_rows, -1) for k in (2, 3))
            s = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) if t.num_rows else np.zeros(0)
            keep = pa.array(s >= least)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep), pa.array(s).filter(keep)], names=["a", "b", "similarity"])

    return run


def similar_pairs(df: DataFrame, key: str, vector: str, *, least: float, dim: int = 128, sides: str | None = None, cell: int = C.CELL, coarse: int = C.COARSE, dense: int = C.DENSE) -> DataFrame:
    """``a, b, similarity``: pairs with a cosine of at least ``least``, a < b. With ``sides`` (a boolean column) only pairs of
    different sides.

    A vector is kept in two cells and asks as many as ``PROBES`` says, so the rows per vector do not depend on their
    number; up to some two thousand vectors there is one cell and the join is exact, above it has a recall (README).
    Vectors of one direction are one class: only the first of a class and side goes to the cells, and the others have its
    pairs and each other. Similarities are computed in float64 from the vectors as given."""
    mark = F.col(sides).cast("boolean") if sides else F.lit(False)
    rows = df.filter(vectors.usable(vector, dim)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), mark.alias("mark")).dropDuplicates(["id"])
    own = cut(rows, "vectors")
    hashed, _ = C.direction_classes(own, dim)
    marked = hashed.join(own.select("id", "mark"), "id") if sides else hashed.withColumn("mark", F.lit(False))
    first = marked.groupBy("h1", "h2", "mark").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    member = cut(marked.join(first, ["h1", "h2", "mark"]).select("id", "rep", "mark", "n", "h1", "h2"), "members")
    count = member.agg(F.count_if(F.col("id") == F.col("rep")).alias("reps"), F.count_if(F.col("n") > 1).alias("copies")).first()
    total = int(count.reps)
    if total == 0:
        return df.sparkSession.createDataFrame([], "a long, b long, similarity double")
    lead = own.join(member.filter("id = rep").select("id"), "id", "left_semi").withColumn("asks", F.lit(True))
    probe = next(n for bound, n in PROBES if least >= bound or bound == 0.0)
    cells = C.Cells.fit(C.sample_vectors(lead.select("id", "v"), dim), max(1, total // cell), coarse)
    met = C.meet(lead, _products(dim, least, bool(sides)), "a long, b long, similarity double", dim=dim, cells=cells, total=total, keep=2, probe=probe, dense=dense)
    pairs = met.select("a", "b").distinct()
    if count.copies:
        pairs = cut(pairs, "class-pairs")
        more = member.filter("n > 1").select("rep", "id", "n")
        for end in ("a", "b"):
            pairs = pairs.join(more.select(F.col("rep").alias(end), F.col("id").alias("other")), end, "left").withColumn(end, F.coalesce("other", end)).drop("other")
        # a class is dealt over tasks: one side by hash, the other to every part
        if sides:
            sized = member.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
            group = member.join(sized, ["h1", "h2"]).select(F.struct("h1", "h2").alias("g"), "id", "mark", F.col("m").alias("n"))
        else:
            group = member.filter("n > 1").select(F.col("rep").alias("g"), "id", "mark", "n")
        group = group.withColumn("parts", F.ceil(F.col("n") / CLASS_PART).cast("int"))
        one = group.select("g", F.col("id").alias("a"), F.col("mark").alias("sa"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
        two = group.select("g", F.col("id").alias("b"), F.col("mark").alias("sb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        within = one.join(two, ["g", "part"]).filter("a < b" + (" and sa <> sb" if sides else "")).select("a", "b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(within).distinct()
    v = own.select("id", "v")
    both = pairs.join(v.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    return both.select("a", "b", "va", "vb").mapInArrow(_exact(least), "a long, b long, similarity double")
