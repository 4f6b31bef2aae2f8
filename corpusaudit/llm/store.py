"""Reading the given tables, and tables that a job writes for itself in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.sources.state import new_dir

# Rows of a table of keys up to which it is sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored in the shared folder and read back: cuts lineage, and every later reader sees
    the same rows even if an executor is lost."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns what a Python worker has freed to the system. Workers outlive their tasks, and the memory that
    one stage has freed would count beside what the next one needs."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marks a side for broadcast if its counted ``rows`` are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """The rows of ``df`` as one struct column beside ``keys``, so that no column of the caller can
    clash with a name used inside an operator. ``unpacked`` undoes it."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[k.alias(n) for n, k in keys.items()])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def fresh_name(stem: str) -> str:
    return f"{stem}_{uuid.uuid4().hex[:8]}"
