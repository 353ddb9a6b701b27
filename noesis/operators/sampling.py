"""Bounded, repeatable samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCALE = 1 << 30


def bounded_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df`` in the order of a hash of ``keys``: the same rows whatever the partitioning.

    Rows are thinned by a hash threshold set from the count before they are ranked, so that what partitions hand to the
    ranking adds up to a little over ``rows`` on any number of partitions; if the threshold keeps all, nothing is lost.
    """
    total = df.count()
    h = F.xxhash64(*keys)
    if total > 2 * rows:
        df = df.filter(F.pmod(h, F.lit(_SCALE)) < int(_SCALE * min(1.0, 1.25 * rows / total + 40.0 / total)))
    return df.orderBy(h, *keys).limit(rows)
