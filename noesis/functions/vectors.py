"""Vector expressions, JVM-side, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; 0 where a norm is below 1e-9."""
    n = norm(a) * norm(b)
    return F.when(n > 1e-9, dot(a, b) / n).otherwise(F.lit(0.0))


def unit(a: Column | str) -> Column:
    n = norm(a)
    return F.when(n > 1e-9, F.transform(a, lambda x: x.cast("double") / n))


def usable(a: Column | str, dim: int) -> Column:
    """Right length, finite numbers, not all zero."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(a).isNotNull() & (F.size(a) == dim) & ~bad & F.exists(a, lambda x: x != 0) if isinstance(a, str) else (F.size(a) == dim) & ~bad & F.exists(a, lambda x: x != 0)
