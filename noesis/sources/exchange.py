"""Export, import and snapshots of the store."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noesis.sources.tables import EDGES, ENTITIES, NODE_ENTITIES, NODES, load

TABLES = [NODES, EDGES, ENTITIES, NODE_ENTITIES]


def export_json(spark: SparkSession, base: str, target: str) -> dict[str, int]:
    """One JSON folder per table (notes without vectors) and a manifest of counts."""
    counts = {}
    for name in TABLES:
        df = load(spark, base, name)
        df = df.drop("embedding") if name == NODES else df
        df.write.mode("overwrite").json(f"{target}/{name}")
        counts[name] = spark.read.text(f"{target}/{name}").count()
    manifest = json.dumps({"counts": counts})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/manifest")
    return counts


def import_skills(spark: SparkSession, path: str, notes: DataFrame | None = None) -> DataFrame:
    """Skills from a JSON list of {name, purpose, when_to_use, category, importance, intensity, tags} as notes, without those
    whose name stands in a note (``notes``: content); names are few, so they are looked up in all notes."""
    schema = "name string, purpose string, when_to_use string, category string, importance string, intensity int, tags array<string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).filter("name is not null")
    if notes is not None:
        hit = notes.select("content").join(F.broadcast(rows.select(F.col("name").alias("_n"))), F.contains("content", "_n")).select(F.col("_n").alias("name")).distinct()
        rows = rows.join(hit, "name", "left_anti")
    line = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"\n\n{label}: "), c)).otherwise("")
    content = F.concat(F.lit("SKILL LEARNED: "), "name", line("Purpose", F.col("purpose")), line("When to use", F.col("when_to_use")), line("Tags", F.array_join("tags", ", ")))
    return rows.select(content.alias("content"), F.coalesce("category", F.lit("general")).alias("category"), F.coalesce("importance", F.lit("normal")).alias("importance"), F.coalesce("intensity", F.lit(5)).alias("emotional_intensity"), F.array_join("tags", " ").alias("tags"))


def write_skills(skills: DataFrame, path: str) -> None:
    """Skill descriptions (name, purpose, category) as JSON lines."""
    skills.select("name", "purpose", "category").write.mode("overwrite").json(path)


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Skill descriptions: one row per SKILL.md with its folder as category, its heading and its first two long lines."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="SKILL.md").withColumn("path", F.input_file_name())
    lines = F.filter(F.split("value", "\n"), lambda x: (F.length(x) > 40) & ~x.startswith("#"))
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+/SKILL\.md$", 1).alias("category"), F.regexp_extract("value", r"(?m)^#\s+(.+)$", 1).alias("name"), F.array_join(F.slice(lines, 1, 2), " ").alias("purpose"))


_TURNS = "array<struct<speaker:string,dia_id:string,text:string>>"


def read_dialogues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of a JSON list of {conversation: {speaker_a, speaker_b, session_N, session_N_date_time}, qa: [...]}:
    turns have conv_id, session, at, turn, speaker, dia_id, text; questions conv_id, question, answer, category, evidence."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<conversation:map<string,string>,qa:array<struct<question:string,answer:string,category:int,evidence:array<string>>>>>")).alias("conv_id", "c"))
    fields = raw.select("conv_id", F.explode("c.conversation").alias("name", "v"))
    number = F.regexp_extract("name", r"^session_(\d+)$", 1)
    talks = fields.filter(number != "").select("conv_id", number.cast("int").alias("session"), F.posexplode(F.from_json("v", _TURNS)).alias("turn", "t"))
    dated = F.regexp_extract("name", r"^session_(\d+)_date_time$", 1)
    at = fields.filter(dated != "").select("conv_id", dated.cast("int").alias("session"), F.col("v").alias("at"))
    turns = talks.join(at, ["conv_id", "session"], "left").select("conv_id", "session", "at", "turn", F.coalesce("t.speaker", F.lit("?")).alias("speaker"), "t.dia_id", F.coalesce("t.text", F.lit("")).alias("text"))
    return turns, raw.select("conv_id", F.explode("c.qa").alias("q")).select("conv_id", "q.*")


def conversations(turns: DataFrame, granularity: str = "hybrid", *, size: int = 3) -> DataFrame:
    """Notes of dialogues: ``conv_id, session, part, text, dia_ids``, one per session, per turn, or (hybrid) per ``size`` turns of
    a session. A note is the lines of its turns in order, with the speaker in front."""
    order = Window.partitionBy("conv_id", "session").orderBy("turn")
    said = turns.filter("text <> ''").withColumn("line", F.concat("speaker", F.lit(": "), "text")).withColumn("_n", F.row_number().over(order) - 1)
    part = {"session": F.lit(0), "turn": F.col("_n"), "hybrid": F.floor(F.col("_n") / size).cast("int")}[granularity]
    rows = said.withColumn("part", part.cast("int")).groupBy("conv_id", "session", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "line", "dia_id"))).alias("t"))
    return rows.select("conv_id", "session", "part", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("text"), F.transform("t", lambda x: x["dia_id"]).alias("dia_ids"))


def write_results(results: DataFrame, path: str) -> None:
    """Results of an evaluation as JSON lines."""
    results.write.mode("overwrite").json(path)


def snapshot(spark: SparkSession, base: str, folder: str, *, keep: int = 7, name: str | None = None) -> list[str]:
    """Copy the tables to a new version and drop the oldest beyond ``keep``; the versions left, oldest first."""
    version = name or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    for table in TABLES:
        spark.read.parquet(f"{base}/{table}.parquet").write.parquet(f"{folder}/{version}/{table}.parquet")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())
    for old in versions[: max(0, len(versions) - keep)]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, old), True)
    return versions[-keep:]


def restore(folder: str, version: str) -> str:
    """The base folder of a version, to be read in place of the store."""
    return f"{folder}/{version}"
