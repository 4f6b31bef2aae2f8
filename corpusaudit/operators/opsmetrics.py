"""Operational metrics as queries over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.operators.ranking import running_total

# Upper bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = (
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
    float("inf"),
)


def active_gauge(versions: DataFrame) -> DataFrame:
    """Number of active sessions after every start and every end."""
    change = F.when(F.col("status") == "started", 1).when(
        F.col("status").isin("completed", "failed", "cancelled"), -1
    )
    moves = versions.select("ts", "seq", change.alias("change")).filter(F.col("change").isNotNull())
    return running_total(
        moves,
        value="change",
        order=("ts", "seq"),
        name="active",
    )


def latency_histogram(latencies: DataFrame) -> DataFrame:
    """Cumulative buckets, sum and count per agent. All buckets are counted in one partial
    aggregate, so a handful of hot agents costs a handful of shuffled rows."""
    buckets = [
        F.count_if(F.col("seconds") <= bound).alias(f"b{i}")
        for i, bound in enumerate(LATENCY_BOUNDS)
    ]
    totals = latencies.groupBy("agent").agg(
        *buckets, F.sum("seconds").alias("sum_seconds"), F.count("*").alias("n")
    )
    rows = F.array(
        *[
            F.struct(F.lit(str(bound)).alias("le"), F.col(f"b{i}").alias("cumulative"))
            for i, bound in enumerate(LATENCY_BOUNDS)
        ]
    )
    return totals.select("agent", F.inline(rows), "sum_seconds", "n")


def progress_timeline(results: DataFrame, max_iterations: int) -> DataFrame:
    """Progress in percent at the start of every round that a file went through."""
    rounds = F.sequence(F.lit(0), F.col("rounds") - 1)
    timeline = results.select("file_id", F.explode(rounds).alias("iteration"))
    percent = F.floor(F.col("iteration") / max_iterations * 100)
    return timeline.select("file_id", "iteration", percent.alias("progress"))


def convergence_report(results: DataFrame) -> DataFrame:
    """Why files stopped, after how many rounds, with how many steps."""
    return results.groupBy("reason", "rounds").agg(
        F.count("*").alias("n_files"), F.sum(F.size("steps")).alias("n_steps")
    )
