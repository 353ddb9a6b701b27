"""Queries by name, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noesis.sources.tables import load


class Store:
    """The tables of one folder, read on demand: ``store.nodes``, or ``store("nodes", "id", "content")`` for some columns."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    def __call__(self, name: str, *columns: str) -> DataFrame:
        return load(self.spark, self.base, name, *columns)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self(name)


class Catalog:
    """Collects queries: ``@catalog("name", sql)`` on a function of a Store."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.SQL: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable[[Store], DataFrame]) -> Callable[[Store], DataFrame]:
            self.QUERIES[name] = lambda spark, base: f(Store(spark, base))
            if sql:
                self.SQL[name] = sql
            return f

        return add
