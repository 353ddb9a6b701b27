"""Session defaults for tests and benches, and the one way lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "noesis", memory: str = "8g") -> SparkSession:
    """A local session with the settings a cluster would have: UTC, AQE, Arrow; partitions follow the cores."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores if str(cores).isdigit() else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: the cluster's ``spark.checkpoint.dir``. Only on a single machine, where that is unset, a
    folder of our own is made and set; elsewhere executors would each write to their own disks, so it is an error."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="noesis-")
        sc.setCheckpointDir(found)
    return found


def mounted_dir(spark: SparkSession) -> str | None:
    """The shared folder as a path that Python opens by itself, or None where it is no mounted folder (hdfs, object stores)."""
    found = urlparse(shared_dir(spark))
    if found.scheme not in ("", "file"):
        return None
    os.makedirs(found.path, exist_ok=True)
    return found.path


def cut(df: DataFrame, name: str = "part", *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared folder and read it back: columnar and compressed, so smaller than
    ``checkpoint()``, and readable by every executor after any other is lost."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"noesis-{name}-{uuid.uuid4().hex}")
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slots(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: what the session is set to shuffle into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
