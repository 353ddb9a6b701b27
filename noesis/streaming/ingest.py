"""Streams: note ingestion in micro-batches with its triggers, and windows over the event and search log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from noesis.operators import edits, joins, lifecycle, ranking, similarity
from noesis.session import cut

SIMILAR_LINKS = 5
LEAST_SIMILAR = 0.5


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_windows(events: DataFrame, *, at: str = "ts", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per window and type; events later than the watermark are dropped by contract of the stream."""
    return (
        events.withWatermark(at, late).groupBy(F.window(at, width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("begin"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, *, at: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a user: events with gaps below ``gap``."""
    return (
        events.withWatermark(at, late).groupBy(F.session_window(at, gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")
    )


def log_windows(log: DataFrame, *, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """The search log by window: searches, those without result, mean and largest milliseconds."""
    return (
        log.withWatermark("timestamp", late).groupBy(F.window("timestamp", width))
        .agg(F.count(F.lit(1)).alias("searches"), F.count_if(F.col("results_count") == 0).alias("zero_results"), F.avg("latency_total_ms").alias("mean_ms"), F.max("latency_total_ms").alias("most_ms"))
        .select(F.col("window.start").alias("begin"), "searches", "zero_results", "mean_ms", "most_ms")
    )


def new_notes(batch: DataFrame, store: DataFrame, *, least: float = 0.95, dim: int = 128) -> DataFrame:
    """The notes of a batch that are no near copies of stored notes or of earlier notes of the batch (by ``arrival``). Stored
    and new notes are sides of one join by similarity, and copies inside the batch come from a second one of the batch."""
    arrival = cut(batch.select("id", "embedding", "arrival"), "arrivals")
    fresh = arrival.select("id", "embedding").withColumn("_key", F.col("id") * 2)
    old = store.select("id", "embedding").withColumn("_key", F.col("id") * 2 + 1)
    both = fresh.select("_key", "embedding", F.lit(True).alias("fresh")).unionByName(old.select("_key", "embedding", F.lit(False).alias("fresh")))
    across = similarity.similar_pairs(both, "_key", "embedding", least=least, dim=dim, sides="fresh")
    even = F.when(F.col("a") % 2 == 0, F.col("a")).otherwise(F.col("b"))
    stored = across.select((even / 2).cast("long").alias("id")).distinct()
    pairs = similarity.similar_pairs(arrival, "id", "embedding", least=least, dim=dim)
    times = arrival.select("id", "arrival")
    met = pairs.join(times.select(F.col("id").alias("a"), F.col("arrival").alias("ta")), "a").join(times.select(F.col("id").alias("b"), F.col("arrival").alias("tb")), "b")
    # a < b, so of equal times b is the later
    later = met.select(F.when(F.col("tb") < F.col("ta"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct()
    return batch.join(stored.unionByName(later).distinct(), "id", "left_anti")


def added(t, batch: DataFrame, *, now: str, force: bool = False, emotions: bool = False, least: float = 0.95, extractor=None) -> dict[str, DataFrame]:
    """Tables after the notes of ``batch`` come in: near copies left out unless ``force``, ids and defaults, entities and
    co-mention edges where there is an ``extractor``, up to five similar notes from 0.5 on both ways, the six nearest in time,
    and the links of mini-consolidation."""
    nodes, edges = t.nodes, t.edges
    rows = batch.withColumn("_no", F.monotonically_increasing_id())
    if not force and "embedding" in batch.columns:
        keyed = cut(rows.withColumn("id", F.col("_no")).withColumn("arrival", F.col("_no")), "incoming")
        rows = new_notes(keyed, nodes.select("id", "embedding"), least=least).drop("id", "arrival")
    made = lifecycle.new_notes(rows.drop("_no"), nodes, now=now, emotions=emotions)
    made = cut(made.select(*[(F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in nodes.schema]), "new-notes")
    every = nodes.unionByName(made)
    out = {"nodes": every}
    ids = made.select("id")
    links = [similar_links(made, every), time_links(every, ids), lifecycle.mini_consolidation(made, every)]
    if extractor is not None:
        from noesis.functions.plugins import extracted

        found = cut(extracted(made, "id", "content", extractor), "found-entities")
        entities, known = lifecycle.entity_ids(t.entities, found)
        new = found.join(known, ["name", "entity_type"]).select(F.col("id").alias("node_id"), "entity_id")
        out |= {"entities": entities, "node_entities": lifecycle.linked(t.node_entities, new)}
        links.append(lifecycle.co_mention_edges(out["node_entities"], new))
    new_edges = links[0]
    for more in links[1:]:
        new_edges = new_edges.unionByName(more.select(*new_edges.columns))
    out["edges"] = edits.upsert_edges(edges, new_edges.withColumn("created_at", F.lit(now).cast("timestamp")))
    return out


def similar_links(made: DataFrame, every: DataFrame) -> DataFrame:
    """Semantic edges both ways between new notes and their most similar ones."""
    near = ranking.nearest(made.select(F.col("id").alias("query_id"), "embedding"), every.select("id", "embedding"), k=SIMILAR_LINKS + 1, least=LEAST_SIMILAR).filter("query_id <> node_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    near = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= SIMILAR_LINKS)
    one = near.select(F.col("query_id").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("semantic").alias("edge_type"), F.col("score").alias("weight"))
    return one.unionByName(one.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "edge_type", "weight"))


def time_links(every: DataFrame, ids: DataFrame, k: int = 6) -> DataFrame:
    """TEMPORAL_BEFORE and TEMPORAL_AFTER edges between new notes (id) and the nearest in event time: the earlier note is
    before."""
    timed = every.select("id", F.col("t_event_start").alias("timestamp"))
    near = joins.nearest_in_time(timed, k=k).join(ids.select(F.col("id").alias("a")), "a", "left_semi")
    earlier = F.col("relation") == "TEMPORAL_AFTER"  # b lies before a
    first, second = F.when(earlier, F.col("b")).otherwise(F.col("a")), F.when(earlier, F.col("a")).otherwise(F.col("b"))
    pairs = near.select(first.alias("x"), second.alias("y")).distinct()
    before = pairs.select(F.col("x").alias("source_id"), F.col("y").alias("target_id"), F.lit("TEMPORAL_BEFORE").alias("edge_type"), F.lit(0.4).alias("weight"))
    return before.unionByName(pairs.select(F.col("y").alias("source_id"), F.col("x").alias("target_id"), F.lit("TEMPORAL_AFTER").alias("edge_type"), F.lit(0.4).alias("weight")))


class Trigger:
    """When the upkeep batch is due: after ``notes`` new notes, or ``hours`` since the last run (0: never by time)."""

    def __init__(self, notes: int = 50, hours: float = 6.0) -> None:
        self.notes, self.hours = notes, hours

    def due(self, new: int, last: str | None, now: str) -> bool:
        from datetime import datetime

        by_time = self.hours > 0 and (last is None or (datetime.fromisoformat(now) - datetime.fromisoformat(last)).total_seconds() >= self.hours * 3600)
        return new >= self.notes or by_time

    def of(self, store, now: str) -> bool:
        """Whether the batch is due for a store, by its notes since ``last_sleep_at`` and the clock."""
        mark = store("metadata").filter("key = 'last_sleep_at'").select("value").first()
        last = mark[0] if mark else None
        nodes = store("nodes", "timestamp")
        new = (nodes.filter(F.col("timestamp") > F.lit(last).cast("timestamp")) if last else nodes).count()
        return self.due(new, last, now)


def ingest(stream: DataFrame, read_store: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that takes each micro-batch through the duplicate gate, numbers what is new, and hands it to ``write``."""

    def batch(df: DataFrame, epoch: int) -> None:
        if df.isEmpty():
            return
        store = read_store()
        fresh = new_notes(df, store).drop("id")
        write(edits.number_new(fresh, store, ["arrival", "content"]), epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def ingest_whole(stream: DataFrame, read_store: Callable[[], object], write: Callable[[dict[str, DataFrame], int], None], checkpoint: str, *, now: Callable[[], str], trigger: Trigger | None = None, sleep: Callable[[str], None] | None = None, every: str | None = None) -> DataStreamWriter:
    """A writer that brings each micro-batch into the store with all its links (``added``), hands the new tables to ``write``,
    and calls ``sleep`` when the upkeep batch is due. ``every`` is the interval of batches; without, what is there is taken."""

    def batch(df: DataFrame, epoch: int) -> None:
        if df.isEmpty():
            return
        moment = now()
        write(added(read_store(), df, now=moment), epoch)
        if trigger is not None and sleep is not None and trigger.of(read_store(), moment):
            sleep(moment)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return w.trigger(processingTime=every) if every else w.trigger(availableNow=True)


def drain(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Events to a file sink, which any number of readers can read from where they stand: exactly once by the offsets."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
