"""The search log: its rows, and what it says of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noesis.session import cut

PHASES = ["embedding", "ann", "spreading", "bm25", "temporal", "rerank"]
SCHEMA = "query string, timestamp timestamp, category string, results_count int, top1_score double, top5_scores string, latency_total_ms double, " + ", ".join(f"latency_{p}_ms double" for p in PHASES)


def log_rows(queries: DataFrame, found: DataFrame, *, now: str, timings: dict[str, float] | None = None) -> DataFrame:
    """A row per query (query_id, text), with its results (query_id, score, place): their number, the best score, the five
    best as JSON, and the milliseconds of each phase, which are those of the whole batch."""
    t = timings or {}
    got = found.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("score").alias("best"), F.slice(F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", F.round("score", 4).alias("s"))))), 1, 5).alias("five"))
    q = queries.select("query_id", F.col("text").alias("query")).join(got, "query_id", "left")
    phase = [F.lit(float(t.get(p, 0.0))).alias(f"latency_{p}_ms") for p in PHASES]
    five = F.to_json(F.transform(F.coalesce("five", F.array().cast("array<struct<place:int,s:double>>")), lambda x: x["s"]))
    return q.select("query", F.lit(now).cast("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("category"), F.coalesce("n", F.lit(0)).alias("results_count"), F.col("best").alias("top1_score"), five.alias("top5_scores"), F.lit(float(sum(t.values()))).alias("latency_total_ms"), *phase)


def append(rows: DataFrame, path: str) -> None:
    """Add rows to the log, a parquet folder by day, so a day's statistics read a day."""
    rows.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def ranked_values(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the value at place floor(n x share) of the sorted values, counted from 0, and the largest (``most``): exact.

    Equal values are counted before they are ranked, and values are ranked by range partitions, so no group is gathered
    in one task."""
    from noesis.operators.joins import positions

    c = cut(rows.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")), "values")
    n = c.groupBy("g").agg(F.sum("c").alias("n"), F.max("v").alias("most"))
    upto = positions(c, ["g", "v"], weight="c").withColumnRenamed("pos", "upto")
    before = upto.groupBy("g").agg(F.min(F.col("upto") - F.col("c")).alias("base"))
    r = upto.join(before.join(n, "g"), "g").withColumn("upto", F.col("upto") - F.col("base"))
    picks = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * s), F.col("v"))).alias(name) for name, s in shares.items()]
    return r.groupBy("g").agg(*picks, F.max("most").alias("most")).withColumnRenamed("g", group)


def statistics(log: DataFrame, *, day: str) -> DataFrame:
    """One row about the searches of a day (UTC) and of all time: counts, latencies by index, mean scores of searches with
    results, mean milliseconds of phases."""
    today = log.filter(F.to_date("timestamp") == F.lit(day).cast("date"))
    means = today.agg(
        F.count(F.lit(1)).alias("searches"), F.count_if(F.col("results_count") == 0).alias("zero_results"),
        F.round(F.avg(F.when(F.col("results_count") > 0, F.col("top1_score"))), 4).alias("mean_top1"), F.round(F.avg(F.when(F.col("results_count") > 0, F.col("results_count"))), 1).alias("mean_results"),
        *[F.round(F.avg(f"latency_{p}_ms"), 1).alias(f"mean_{p}_ms") for p in PHASES],
    )
    late = ranked_values(today.withColumn("_all", F.lit(1)), "_all", "latency_total_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("_all")
    whole = log.agg(F.count(F.lit(1)).alias("searches_ever"))
    return means.join(late, F.lit(True), "left").crossJoin(whole)


def zero_results(log: DataFrame, most: int = 10) -> DataFrame:
    """The latest queries that found nothing."""
    return log.filter("results_count = 0").orderBy(F.desc("timestamp"), "query").limit(most).select("query", "timestamp")
