"""Where jobs keep data of their own, and the append-only tables that hold state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.operators.sessions import current_sessions

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in local mode."""
    configured = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_DIR
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors reach")
    return tempfile.mkdtemp(prefix="corpusaudit-")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusaudit/{name}-{uuid.uuid4().hex}"


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a table; nothing that is stored is read or rewritten."""
    rows.write.mode("append").parquet(path)


def save_sessions(versions: DataFrame, path: str) -> None:
    """Upsert by id: versions are appended and the newest one is read. All files of a version table
    have ``started_at``, which only compacted versions fill."""
    if "started_at" not in versions.columns:
        unknown = F.lit(None).cast(versions.schema["ts"].dataType)
        versions = versions.withColumn("started_at", unknown)
    append(versions, path)


def load_sessions(spark: SparkSession, path: str) -> DataFrame:
    return current_sessions(spark.read.parquet(path))


def compact_sessions(spark: SparkSession, source: str, target: str) -> None:
    """Rewrites a version table to the newest version of every session. Readers of ``source`` are
    not disturbed; they move to ``target`` once it is complete."""
    current = load_sessions(spark, source)
    current.withColumnRenamed("updated_at", "ts").write.mode("errorifexists").parquet(target)


def write_files(plan: DataFrame, path: str) -> None:
    """The new text of every file in an apply plan, as a (path, content) table."""
    plan.select("path", "content").write.mode("overwrite").parquet(path)


def read_back(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path).select(*[F.col(c) for c in like.columns])
