"""Typed access to the store's tables: one parquet path per table under a base folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = "nodes"
EDGES = "edges"
ENTITIES = "entities"
NODE_ENTITIES = "node_entities"
CONTRADICTIONS = "contradiction_log"
SUMMARIES = "cluster_summaries"
REMOVED = "removed_records"
LANGS = "note_langs"
DOCUMENTS = "documents"
EVAL_ITEMS = "eval_items"


def load(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """Read ``{base}/{name}.parquet``, keep ``columns`` (all if none are named), and turn zone-less timestamps, which are
    UTC, into instants. Projection happens before the cast, so the scan reads only those columns."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in stamps}) if stamps else df
