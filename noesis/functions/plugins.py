"""What may be plugged in: encoders, entity extractors, relation extractors and pair scorers, each as a protocol on lists and
wrapped for Arrow batches; and plain stand-ins that need no model."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noesis.functions import text


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class EntityExtractor(Protocol):
    def entities(self, texts: list[str]) -> list[list[tuple[str, str, float]]]: ...


class RelationExtractor(Protocol):
    def relations(self, texts: list[str]) -> list[list[tuple[str, str, str, float]]]: ...


class PairScorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class HashingEncoder:
    """Vectors of a text's words and word pairs by signed hashing, normalised: for tests and where no model is at hand."""

    def __init__(self, dim: int = 128) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        import re
        from hashlib import blake2b

        out = np.zeros((len(texts), self.dim))
        for row, t in enumerate(texts):
            words = re.findall(r"[^\W_]+", (t or "").lower())
            for w in [*words, *(" ".join(p) for p in zip(words, words[1:]))]:
                h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
                out[row, h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class KnownEntities:
    """The known entities of the vocabulary, by spelling."""

    def entities(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        import re

        from noesis import vocabulary as V

        out = []
        for t in texts:
            low, found = (t or "").lower(), {}
            for kind, table in V.KNOWN.items():
                for spelled, name in table.items():
                    if re.search(rf"(?<!\w){re.escape(spelled)}(?!\w)", low) if len(spelled) <= 3 else spelled in low:
                        found.setdefault(name.lower(), (name, kind, 1.0))
            out.append(list(found.values()))
        return out


class WordOverlap:
    """A pair's share of common words: stands in for a cross-encoder."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        words = lambda t: set(text.re.findall(r"[^\W_]+", (t or "").lower()))
        return [len(a & b) / max(1, len(a | b)) for a, b in ((words(x), words(y)) for x, y in pairs)]


def encoded(encoder: Encoder):
    """A function from a text column to a vector column."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        v = encoder.encode(["" if x is None else x for x in s])
        return pd.Series(list(np.asarray(v, np.float32)))

    return lambda c: run(c)


def extracted(df: DataFrame, key: str, content: str, extractor: EntityExtractor, *, least: float = 0.4) -> DataFrame:
    """``key, name, entity_type, confidence``: entities of every text from ``least`` on, the first of a name in any case;
    technology is called tech."""
    rows = df.select(F.col(key).alias("key"), F.col(content).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, found in zip(f["key"], extractor.entities(list(f["text"]))):
                seen: set[str] = set()
                for name, typ, sure in found:
                    if sure >= least and name.lower() not in seen:
                        seen.add(name.lower())
                        out.append((k, name, "tech" if typ == "technology" else typ, sure))
            yield pd.DataFrame(out, columns=["key", "name", "entity_type", "confidence"])

    return rows.mapInPandas(run, f"key {kind}, name string, entity_type string, confidence double").withColumnRenamed("key", key)


def related(df: DataFrame, key: str, content: str, extractor: RelationExtractor, *, least: float = 0.3) -> DataFrame:
    """``key, head, relation, tail, confidence``: relations of every text from ``least`` on."""
    rows = df.select(F.col(key).alias("key"), F.col(content).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(k, *r) for k, found in zip(f["key"], extractor.relations(list(f["text"]))) for r in found if r[3] >= least]
            yield pd.DataFrame(out, columns=["key", "head", "relation", "tail", "confidence"])

    return rows.mapInPandas(run, f"key {kind}, head string, relation string, tail string, confidence double").withColumnRenamed("key", key)


def judge(scorer: PairScorer, queries: DataFrame, notes: DataFrame):
    """A judge for the search: from (query_id, node_id) to their score by the texts of queries (query_id, text) and notes
    (id, content)."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(scorer.score(list(zip(a, b))))

    def of(pairs: DataFrame) -> DataFrame:
        p = pairs.join(queries.select("query_id", F.col("text").alias("_q")), "query_id").join(notes.select(F.col("id").alias("node_id"), F.col("content").alias("_c")), "node_id")
        return p.select("query_id", "node_id", run(F.coalesce("_q", F.lit("")), F.coalesce("_c", F.lit(""))).alias("score"))

    return of
