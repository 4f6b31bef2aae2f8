"""Ordinals and running totals that never put one key, or the whole table, into one task.

Every row gets the number of its range in the full order, which splits a hot key or a crowded moment over
as many ranges as its share of the rows asks for. The borders of the ranges come from a seeded sample,
as a subquery of the same plan, so the number is a function of the row: it is the same for the totals and
for the rows, also when executors are lost, and nothing is written. Counts per range are then
prefix-summed, and only rows of one range are ordered together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BEFORE = (W.unboundedPreceding, -1)
# Rows of a range, about; their number follows the size of the table.
ROWS_PER_RANGE = 1_000_000
# Sampled rows per range.
SAMPLED = 30
SEED = 7


def _in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with ``_part``, which grows with ``order``; rows must differ in ``order``."""
    n = df.count()
    ranges = math.ceil(n / ROWS_PER_RANGE)
    if ranges <= 1:
        return df.withColumn("_part", F.lit(0))
    place = F.struct(*order)
    sampled = df.select(place.alias("place")).sample(min(1.0, ranges * SAMPLED / n), SEED)
    # every so many of the sorted sample is a border; their first level leads to a few of the second
    step = max(1, math.isqrt(ranges))
    borders = F.filter(
        F.array_sort(F.collect_list("place")), lambda _, i: i % SAMPLED == SAMPLED - 1
    )
    levels = sampled.agg(borders.alias("b")).select(
        F.transform(
            F.sequence(F.lit(0), F.floor(F.size("b") / step).cast("int")), lambda k: F.slice("b", k * step + 1, step)
        ).alias("levels")
    )

    def below(places, bound):
        return F.size(F.filter(places, lambda x: x <= bound))

    numbered = df.withColumn("_levels", levels.scalar()).withColumn("_place", place)
    first = below(F.transform(F.filter("_levels", lambda x: F.size(x) > 0), lambda x: F.get(x, F.lit(0))), F.col("_place"))
    chosen = F.greatest(first - 1, F.lit(0))
    part = chosen * step + below(F.get("_levels", chosen), F.col("_place"))
    return numbered.withColumn("_part", part).drop("_levels", "_place")


def ordinal_in_group(df: DataFrame, *, key: str, order: Sequence[str], name: str) -> DataFrame:
    """0-based position of every row within its key, in ``order``."""
    rows = _in_order(df, (key, *order))
    totals = rows.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    # At most one row per key and partition enters this window.
    by_key = W.partitionBy(key).orderBy("_part").rowsBetween(*_BEFORE)
    offsets = totals.select(
        key, "_part", F.coalesce(F.sum("_n").over(by_key), F.lit(0)).alias("_offset")
    )
    local = F.row_number().over(W.partitionBy("_part", key).orderBy(*order)) - 1
    joined = rows.withColumn("_local", local).join(offsets, ["_part", key])
    return joined.withColumn(name, F.col("_offset") + F.col("_local")).drop(
        "_part", "_offset", "_local"
    )


def running_total(df: DataFrame, *, value: str, order: Sequence[str], name: str) -> DataFrame:
    """Running sum of ``value`` over the whole table in ``order``."""
    rows = _in_order(df, order)
    totals = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    # The only window without a key runs over one row per partition.
    before = W.orderBy("_part").rowsBetween(*_BEFORE)
    offsets = totals.select(
        "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
    )
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum(value).over(within))
    joined = local.join(offsets, "_part")
    return joined.withColumn(name, F.col("_offset") + F.col("_local")).drop(
        "_part", "_offset", "_local"
    )
