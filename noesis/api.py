"""One object with the verbs of the store. Verbs that read return DataFrames; verbs that change the store return the new
tables by name, which the caller writes where the store is kept."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noesis.functions import scanner, text
from noesis.functions.plugins import Encoder, encoded
from noesis.operators import access, edits, joins, lifecycle, searchlog
from noesis.plans import relational, retrieval, upkeep
from noesis.plans.registry import Store
from noesis.session import cut

Tables = dict[str, DataFrame]
_VERSIONS = "note_id long, version_number int, content string, category string, importance string, emotional_tone string, emotional_intensity int, emotional_reflection string, created_at timestamp"


class Memory:
    """The store under ``base``. ``encoder`` makes vectors where texts have none; ``tables`` are tables in place of those
    under ``base``, such as the ones a verb has given."""

    def __init__(self, spark: SparkSession, base: str = "", *, encoder: Encoder | None = None, tables: Tables | None = None) -> None:
        self.store = upkeep.State(Store(spark, base))
        self.spark, self.encoder = spark, encoder
        self.store.own.update(tables or {})

    def after(self, tables: Tables) -> Memory:
        """The memory with some tables changed."""
        m = Memory(self.spark, self.store.first.base, encoder=self.encoder, tables={**self.store.own, **tables})
        m.store.first = self.store.first
        return m

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.store(name)
        except Exception:
            return self.spark.createDataFrame([], schema)

    def _frame(self, rows: list[dict[str, Any]] | DataFrame, schema: str) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows
        names = [f.split()[0] for f in schema.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    def _asked(self, queries: DataFrame | str) -> DataFrame:
        if isinstance(queries, str):
            queries = self.spark.createDataFrame([(0, queries)], "query_id long, text string")
        if "embedding" not in queries.columns:
            if self.encoder is None:
                raise ValueError("queries have no vectors and the memory has no encoder")
            queries = queries.withColumn("embedding", encoded(self.encoder)(F.col("text")))
        return queries

    # reading

    def search_memory(self, queries: DataFrame | str, *, now: str, profile: retrieval.Profile = retrieval.DEFAULT, detail: str | None = None, most: int = 10, **filters) -> DataFrame:
        """Places and scores, or with ``detail`` (brief, full) the notes too."""
        found = retrieval.search(self.store, self._asked(queries), now=now, profile=profile, **filters)
        return retrieval.shown(self.store, found, detail=detail, most=most) if detail else found

    def logged_search(self, queries: DataFrame | str, *, now: str, log: str, **options) -> DataFrame:
        """A search whose rows also go to the search log at ``log``."""
        asked, began = self._asked(queries), time.time()
        found = cut(retrieval.search(self.store, asked, now=now, **options), "found")
        searchlog.append(searchlog.log_rows(asked, found, now=now, timings={"embedding": 0.0, "spreading": 1000 * (time.time() - began)}), log)
        return found

    def search_stats(self, log: str, *, day: str) -> DataFrame:
        return searchlog.statistics(self.spark.read.parquet(log), day=day)

    def get_memory(self, category: str, last: int | str = 2) -> DataFrame:
        return access.read_category(self.store.nodes, category, last)

    def get(self, key: int) -> DataFrame:
        return access.point(self.store.nodes, key).drop("embedding")

    def get_graph(self, ids: DataFrame) -> DataFrame:
        """Neighbours of notes (id) with the beginning of their first line."""
        near = joins.neighbours(self.store("edges", "source_id", "target_id", "weight", "edge_type"), ids)
        return near.join(self.store("nodes", F.col("id").alias("dst"), "category", access.first_line("content", 100).alias("preview")), "dst")

    def neural_stats(self) -> DataFrame:
        return relational.a01t(self.store)

    def health(self) -> DataFrame:
        """The eight signals, their sum and the weakest."""
        return upkeep.signal_row(self.store)

    def find_similar(self, queries: DataFrame | str, *, k: int = 5, least: float = 0.3) -> DataFrame:
        """The most similar notes by similarity to four places, with their first lines."""
        from noesis.operators.ranking import nearest

        near = nearest(self._asked(queries), self.store("nodes", "id", "embedding"), k=k, least=least).withColumn("score", F.bround("score", 4))
        return near.join(self.store("nodes", F.col("id").alias("node_id"), "category", access.first_line("content").alias("preview")), "node_id").orderBy("query_id", F.desc("score"), "node_id")

    def get_note_history(self, ids: DataFrame, most: int = 5) -> DataFrame:
        return lifecycle.history(self._table("note_versions", _VERSIONS), ids, most)

    def list_entity_candidates(self) -> DataFrame:
        return joins.merge_candidates(self.store.entities)

    def list_anchor_policies(self) -> DataFrame:
        return self._table("anchor_policies", lifecycle.POLICY).orderBy("category")

    def get_session_context(self, last: int = 3) -> DataFrame:
        return lifecycle.journal(self.store.nodes, last)

    def extract_remember_blocks(self, texts: DataFrame, column: str = "text") -> DataFrame:
        """A row per block of a text: its body and its attributes."""
        both = F.arrays_zip(text.remember_blocks(column).alias("body"), text.remember_attributes(column).alias("attributes"))
        return texts.select(*[c for c in texts.columns if c != column], F.posexplode(both).alias("pos", "b")).select("*", "b.*").drop("b").withColumnsRenamed({"0": "body", "1": "attributes"})

    # changing

    def add_note(self, notes: DataFrame | list[dict[str, Any]], *, now: str, force: bool = False, emotions: bool = False) -> Tables:
        """Notes (content, category, importance, tags, ...) behind those there, without near copies unless ``force``, with
        their links by similarity and time."""
        from noesis.streaming.ingest import added

        batch = self._frame(notes, "content string, category string, importance string, tags string, emotional_tone string, emotional_intensity int, emotional_reflection string")
        if "embedding" not in batch.columns and self.encoder is not None:
            batch = batch.withColumn("embedding", encoded(self.encoder)(F.col("content")))
        return added(self.store, batch, now=now, force=force, emotions=emotions)

    def update_note(self, changes: DataFrame, *, now: str) -> Tables:
        nodes, versions = lifecycle.updated(self.store.nodes, self._table("note_versions", _VERSIONS), changes, now=now)
        return {"nodes": nodes, "note_versions": versions}

    def restore_note_version(self, wanted: DataFrame, *, now: str) -> Tables:
        nodes, versions = lifecycle.restored(self.store.nodes, self._table("note_versions", _VERSIONS), wanted, now=now)
        return {"nodes": nodes, "note_versions": versions}

    def delete_note(self, ids: DataFrame) -> Tables:
        return dict(zip(("nodes", "edges", "node_entities"), edits.delete_notes(self.store.nodes, self.store.edges, self.store.node_entities, ids)))

    def add_edge(self, edges: DataFrame, *, now: str) -> Tables:
        """Edges (source_id, target_id, edge_type, weight), by default related_to and .7; the larger weight stays."""
        new = edges.withColumn("edge_type", F.coalesce("edge_type", F.lit("related_to")) if "edge_type" in edges.columns else F.lit("related_to"))
        new = new.withColumn("weight", F.coalesce("weight", F.lit(0.7)) if "weight" in edges.columns else F.lit(0.7)).withColumn("created_at", F.lit(now).cast("timestamp"))
        return {"edges": edits.upsert_edges(self.store.edges, new)}

    def set_importance(self, ids: DataFrame, level: str) -> Tables:
        from noesis.vocabulary import IMPORTANCE

        if level not in IMPORTANCE:
            raise ValueError(f"importance is one of {', '.join(IMPORTANCE)}")
        mark = ids.select("id").distinct().withColumn("_m", F.lit(True))
        return {"nodes": self.store.nodes.join(mark, "id", "left").withColumn("importance", F.when(F.col("_m"), level).otherwise(F.col("importance"))).drop("_m")}

    def merge_entities(self, mapping: DataFrame) -> Tables:
        return dict(zip(("entities", "node_entities"), edits.merge_entities(self.store.entities, self.store.node_entities, mapping)))

    def add_anchor_policy(self, categories: DataFrame, *, now: str) -> Tables:
        return {"anchor_policies": lifecycle.policies_added(self._table("anchor_policies", lifecycle.POLICY), categories, now=now)}

    def remove_anchor_policy(self, categories: DataFrame) -> Tables:
        return {"anchor_policies": lifecycle.policies_removed(self._table("anchor_policies", lifecycle.POLICY), categories)}

    def ingest_skill(self, files: DataFrame, *, now: str, confirmed: bool = False) -> tuple[DataFrame, Tables]:
        """(verdict on every file (text, source), tables): confirmed files become notes, others only show what they would be."""
        seen = scanner.ingest_skills(files, today=now[:10], confirmed=F.lit(confirmed))
        notes = seen.filter("status = 'ingested'").select("content", "category", "importance", "tags")
        return seen, self.add_note(notes, now=now, force=True) if confirmed else {}

    def update_working_memory(self, content: str, *, now: str) -> Tables:
        """An entry of the journal, linked to the one before."""
        tables = self.add_note([{"content": content, "category": "working-memory", "importance": "critical", "tags": "working-memory"}], now=now, force=True)
        before = self.store.nodes.filter("category = 'working-memory' and timestamp is not null").orderBy(F.desc("timestamp"), F.desc("id")).limit(1).select(F.col("id").alias("target_id"))
        new = tables["nodes"].join(self.store("nodes", "id"), "id", "left_anti").filter("category = 'working-memory'").select(F.col("id").alias("source_id"))
        link = new.crossJoin(F.broadcast(before)).select("source_id", "target_id", F.lit("temporal_chain").alias("edge_type"), F.lit(0.95).alias("weight"), F.lit(now).cast("timestamp").alias("created_at"))
        return {**tables, "edges": tables["edges"].unionByName(edits.insert_edges(tables["edges"], link).select(*tables["edges"].columns))}

    update_session_context = update_working_memory

    def add_intention(self, content: str, *, now: str, due: str | None = None) -> Tables:
        return self.add_note(lifecycle.intentions(self.spark.createDataFrame([(content, due)], "content string, due string")), now=now, force=True)

    def complete_intention(self, done: DataFrame) -> Tables:
        return {"nodes": lifecycle.intentions_completed(self.store.nodes, done)}

    def sleep_compute(self, *, now: str, dry_run: bool = True, only: list[str] | None = None, **options) -> tuple[dict[str, int], Tables]:
        counts, state = upkeep.run(self.store, now=now, dry_run=dry_run, only=only, **options)
        return counts, dict(state.own)


def main(arguments: list[str] | None = None) -> None:
    """``python -m noesis.api BASE VERB ...``: search, stats, graph, get, history, health, sleep, check, repl; rows as JSON
    lines. Vectors of queries come from the hashing stand-in; a store with vectors of a model is asked by its notes."""
    import argparse

    from noesis.functions.plugins import HashingEncoder
    from noesis.session import local_session

    p = argparse.ArgumentParser(prog="noesis")
    p.add_argument("base")
    p.add_argument("verb", choices=["search", "stats", "graph", "get", "history", "health", "sleep", "check", "repl"])
    p.add_argument("words", nargs="*")
    p.add_argument("--limit", type=int, default=5)
    p.add_argument("--category")
    p.add_argument("--full", action="store_true")
    p.add_argument("--now", default=time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime()))
    a = p.parse_args(arguments)
    memory = Memory(local_session("*", "noesis"), a.base, encoder=HashingEncoder())
    run_verb(memory, a.verb, a.words, a)


def run_verb(memory: Memory, verb: str, words: list[str], a) -> None:
    spark = memory.spark
    one = lambda: spark.createDataFrame([(int(words[0]),)], "id long")
    if verb == "repl":
        while line := input("noesis> ").split():
            if line[0] in ("exit", "quit"):
                return
            run_verb(memory, line[0], line[1:], a)
        return
    if verb == "sleep":
        counts, _ = memory.sleep_compute(now=a.now, dry_run=True)
        print(counts)
        return
    out = {
        "search": lambda: memory.search_memory(" ".join(words), now=a.now, profile=retrieval.Profile(limit=a.limit), detail="full" if a.full else "brief", most=a.limit, category=a.category),
        "stats": memory.neural_stats, "health": memory.health, "graph": lambda: memory.get_graph(one()), "get": lambda: memory.get(int(words[0])), "history": lambda: memory.get_note_history(one()),
        "check": lambda: memory.search_memory("what is current", now=a.now, detail="brief", most=a.limit),
    }[verb]()
    for row in out.limit(1000).toJSON().toLocalIterator():
        print(row)


if __name__ == "__main__":
    main()
