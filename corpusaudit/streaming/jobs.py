"""Streaming jobs: scan files as they arrive, and keep counts and states of sessions up to date.

Each job drains what is there (``availableNow``) and continues from its checkpoint on the next
run. Every micro-batch is reduced and written into a folder of its own, and folders are rolled up
(``batches``): a batch that is replayed after a failure overwrites its folder, and readers add up, or
take the newest, over all batches. No lateness bound applies, so results do not depend on how rows are dealt to batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusaudit.operators.scan import vuln_counts
from corpusaudit.sources.files import python_files
from corpusaudit.streaming.batches import Merge, read_batches, write_batch

WINDOW = "1 day"


def file_stream(spark: SparkSession, root: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """Rows of the parquet table ``name`` below ``root``, one file or a folder of part files, as
    its files appear."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    is_folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    schema = spark.read.parquet(f"{root}/{name}").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if is_folder:
        return stream.parquet(f"{root}/{name}")
    return stream.option("pathGlobFilter", name).parquet(root)


def _drain(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


LEDGER = "file_id {0}, digest string, seq bigint"


def _newest_digest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file_id").agg(F.max_by("digest", "seq").alias("digest"), F.max("seq").alias("seq"))


def stream_scan(
    arrivals: DataFrame, to_code: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> None:
    """Scans arriving Python files. A delivery is scanned unless its text is the one that the file had last:
    a file that is set back to an earlier text is scanned again.

    What each file had last is a ledger of digests beside ``out``, rolled up to one row per file, so it grows with the
    files and not with their deliveries. Texts of one file in the same micro-batch have no order:
    each is scanned once, and whatever comes next counts as new. ``to_code`` turns arriving rows into
    (file_id, path, code).
    """
    ledger = f"{out.rstrip('/')}-ledger"

    def write(batch: DataFrame, batch_id: int) -> None:
        code = to_code(batch.drop("arrived_at")).withColumn("digest", F.coalesce(F.md5("code"), F.lit("unreadable")))
        schema = LEDGER.format(code.schema["file_id"].dataType.simpleString())
        last = _newest_digest(read_batches(code.sparkSession, ledger, schema, before=batch_id))
        fresh = code.dropDuplicates(["file_id", "digest"]).join(last.select("file_id", "digest"), ["file_id", "digest"], "left_anti")
        write_batch(vuln_counts(python_files(fresh.drop("digest"))), out, batch_id, lambda rows: rows)
        one = F.when(F.min("digest") == F.max("digest"), F.min("digest")).otherwise("")
        now = code.groupBy("file_id").agg(one.alias("digest")).withColumn("seq", F.lit(batch_id).cast("bigint"))
        write_batch(now, ledger, batch_id, _newest_digest)

    _drain(arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


def scan_results(spark: SparkSession, out: str) -> DataFrame:
    """All findings so far."""
    return read_batches(spark, out)


def _reduce_batches(
    rows: DataFrame, reduce: Callable[[DataFrame], DataFrame], merge: Merge, out: str, checkpoint: str
) -> None:
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(reduce(batch), out, batch_id, merge)

    _drain(
        rows.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )


def _summed(keys: Sequence[str]) -> Merge:
    def merge(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])

    return merge


def summed_per_key(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Sum of every value over all micro-batches."""
    return _summed(keys)(read_batches(spark, out))


def stream_step_counts(steps: DataFrame, out: str, checkpoint: str) -> None:
    """Applied steps per day, agent and kind of edit."""

    def count(batch: DataFrame) -> DataFrame:
        counts = batch.groupBy(F.window("ts", WINDOW), "agent", "change_type").agg(F.count("*").alias("n_steps"))
        return counts.select(F.col("window.start").alias("day"), "agent", "change_type", "n_steps")

    _reduce_batches(steps, count, _summed(["day", "agent", "change_type"]), out, checkpoint)


def _gauge_change(status: Column) -> Column:
    return (
        F.when(status == "started", 1)
        .when(status.isin("completed", "failed", "cancelled"), -1)
        .otherwise(0)
    )


def stream_active_gauge(versions: DataFrame, out: str, checkpoint: str) -> None:
    """Net change of active sessions per day."""

    def move(batch: DataFrame) -> DataFrame:
        change = F.sum(_gauge_change(F.col("status"))).alias("change")
        moves = batch.groupBy(F.window("ts", WINDOW)).agg(change)
        return moves.select(F.col("window.start").alias("day"), "change")

    _reduce_batches(versions, move, _summed(["day"]), out, checkpoint)


def active_by_day(spark: SparkSession, out: str) -> DataFrame:
    """Running number of active sessions; one row per day enters the window."""
    running = F.sum("change").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    return summed_per_key(spark, out, ["day"]).select("day", "change", running.alias("active"))


def stream_session_status(versions: DataFrame, out: str, checkpoint: str) -> None:
    """Newest status per session. Every batch is reduced to one row per session before it is
    stored; a row that arrives late loses by its timestamp when the table is read."""

    def newest(batch: DataFrame) -> DataFrame:
        version = F.max(F.struct("ts", "seq", "status", "progress")).alias("v")
        return batch.groupBy("refactor_id").agg(version)

    _reduce_batches(versions, newest, _newest_version, out, checkpoint)


def _newest_version(rows: DataFrame) -> DataFrame:
    return rows.groupBy("refactor_id").agg(F.max("v").alias("v"))


def session_status_now(spark: SparkSession, out: str) -> DataFrame:
    newest = _newest_version(read_batches(spark, out))
    return newest.select("refactor_id", "v.ts", "v.status", "v.progress")
