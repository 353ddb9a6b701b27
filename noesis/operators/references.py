"""References to records that do not exist, were removed, or appeared only later.

A reference frame has ``ref_table, ref_field, row_key, ref_id, created_at, period``; a target frame has ``id`` and,
where records carry a time, ``at``. Distinct keys, not rows, meet the target tables, so a key that holds a third of all
rows is looked up once. The verdict of a key then returns to its rows along two ways: keys with at least ``HEAVY_SHARE``
of the rows (there can be no more than ``1 / HEAVY_SHARE`` of them, whatever the data) by broadcast, all others by a
shuffle join.

Defined cases: a null key is no reference; null table rows, empty tables and extra columns are fine; repeated rows give
one reference; a record that was removed and put back exists; ``late`` needs both times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 1 / 256

FOUND = ["ref_table", "ref_field", "row_key", "ref_id", "period", "reason"]


def month(at: Column | str) -> Column:
    """``yyyy-MM`` of an instant, ``none`` if null."""
    return F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("none"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def edge_references(edges: DataFrame) -> DataFrame:
    """Both ends of every distinct (source, target, type); repeated writings keep the earliest non-null ``created_at``."""
    once = edges.groupBy("source_id", "target_id", "edge_type").agg(F.min("created_at").alias("created_at"))
    once = once.withColumn("row_key", F.concat_ws("|", _text("source_id"), _text("target_id"), _text("edge_type")))
    # both ends read one exchange of the aggregate
    side = lambda c: once.select(
        F.lit("edges").alias("ref_table"), F.lit(c).alias("ref_field"), "row_key", F.col(c).alias("ref_id"), "created_at", month("created_at").alias("period")
    )
    return side("source_id").unionByName(side("target_id"))


def link_references(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``entity_id`` of every distinct (node, entity) link; the period is the month of the note, looked up by note."""
    once = links.groupBy("node_id", "entity_id").agg(F.lit(1).alias("one")).drop("one")
    at = nodes.groupBy(F.col("id").alias("node_id")).agg(F.min("timestamp").alias("note_at"))
    return once.join(at, "node_id", "left").select(
        F.lit("node_entities").alias("ref_table"),
        F.lit("entity_id").alias("ref_field"),
        F.concat_ws("|", _text("node_id"), _text("entity_id")).alias("row_key"),
        F.col("entity_id").alias("ref_id"),
        F.lit(None).cast("timestamp").alias("created_at"),
        month("note_at").alias("period"),
    )


def log_references(log: DataFrame) -> DataFrame:
    """``older_node_id`` of every finding in the contradiction log."""
    return log.select(
        F.lit("contradiction_log").alias("ref_table"),
        F.lit("older_node_id").alias("ref_field"),
        _text("id").alias("row_key"),
        F.col("older_node_id").alias("ref_id"),
        "created_at",
        month("created_at").alias("period"),
    ).distinct()


def verdicts(per_key: DataFrame, targets: DataFrame, removed_ids: DataFrame) -> DataFrame:
    """One row for each distinct ``ref_id`` of ``per_key``: ``present``, ``removed`` and the record's time ``at``."""
    t = targets.groupBy(F.col("id").alias("ref_id")).agg(F.min("at").alias("at"), F.lit(True).alias("present"))
    r = removed_ids.groupBy("ref_id").agg(F.lit(True).alias("removed"))
    keys = per_key.groupBy("ref_id").agg(F.sum("n").alias("n"))
    return keys.join(t, "ref_id", "left").join(r, "ref_id", "left")


def _heavy_keys(per_key: DataFrame) -> list[int]:
    totals = per_key.groupBy("ref_id").agg(F.sum("n").alias("n"))
    whole = per_key.agg(F.sum("n").alias("whole"))
    rows = totals.join(F.broadcast(whole), F.col("n") >= F.col("whole") * HEAVY_SHARE).select("ref_id").collect()
    return [r.ref_id for r in rows]


def _return_to_rows(rows: DataFrame, per_key: DataFrame, verdict: DataFrame, on: list[str]) -> DataFrame:
    heavy = _heavy_keys(per_key)
    light = rows.filter(~F.col("ref_id").isin(heavy)) if heavy else rows
    out = light.join(verdict.filter(~F.col("ref_id").isin(heavy)) if heavy else verdict, on)
    if heavy:
        few = verdict.filter(F.col("ref_id").isin(heavy))
        out = out.unionByName(rows.filter(F.col("ref_id").isin(heavy)).join(F.broadcast(few), on))
    return out


def orphans(refs: DataFrame, targets: DataFrame, removed_ids: DataFrame) -> DataFrame:
    """The references of ``refs`` without a record at their time: columns ``FOUND``, one row each."""
    refs = refs.filter(F.col("ref_id").isNotNull())
    per_key = refs.groupBy("ref_id", "period").agg(F.count(F.lit(1)).alias("n"))
    v = verdicts(per_key, targets, removed_ids).drop("n")
    # a record that exists and has no time can make no reference an orphan
    v = v.filter(F.col("present").isNull() | F.col("at").isNotNull())
    reason = (
        F.when(F.col("present").isNull() & F.col("removed"), "deleted")
        .when(F.col("present").isNull(), "missing")
        .when(F.col("created_at") < F.col("at"), "late")
    )
    return _return_to_rows(refs, per_key, v, ["ref_id"]).withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(*FOUND)


def orphan_counts(refs: DataFrame, targets: DataFrame, removed_ids: DataFrame) -> DataFrame:
    """``ref_table, ref_field, period, reason, orphans``: references are added up per field, key, period and month of creation
    before anything is shuffled by key. Whether a key is there, and whether its month lies before the record's, is judged on
    these counts; only references made in the very month of their record are compared one by one, heavy keys and others
    along their two ways."""
    refs = refs.filter(F.col("ref_id").isNotNull())
    made = F.when(F.col("created_at").isNotNull(), month("created_at"))
    refs = refs.withColumn("made", made)
    per = refs.groupBy("ref_table", "ref_field", "ref_id", "period", "made").agg(F.count(F.lit(1)).alias("n"))
    v = verdicts(per, targets, removed_ids).drop("n").withColumn("since", F.when(F.col("at").isNotNull(), month("at")))
    counted = per.join(v, "ref_id")
    reason = (
        F.when(F.col("present").isNull() & F.col("removed"), "deleted")
        .when(F.col("present").isNull(), "missing")
        .when(F.col("made") < F.col("since"), "late")
    )
    apart = counted.withColumn("reason", reason).filter("reason is not null").select("ref_table", "ref_field", "period", "reason", "n")
    same = v.filter("present and since is not null").select("ref_id", F.col("since").alias("made"), "at")
    close = refs.filter("made is not null").select("ref_table", "ref_field", "ref_id", "period", "made", "created_at")
    late = _return_to_rows(close, per, same, ["ref_id", "made"]).filter(F.col("created_at") < F.col("at"))
    near = late.groupBy("ref_table", "ref_field", "period").agg(F.count(F.lit(1)).alias("n")).select("ref_table", "ref_field", "period", F.lit("late").alias("reason"), "n")
    return apart.unionByName(near).groupBy("ref_table", "ref_field", "period", "reason").agg(F.sum("n").alias("orphans"))
