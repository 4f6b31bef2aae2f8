"""Mixing sources to target weights.

Sizes are summed per source, targets are set by weight under a cap, and a source's repetition rate
is its target over its size. A document is emitted floor(rate) times plus once more if a coin that
is seeded by its id falls below the fraction of the rate.

Null texts have size 0; rows without a source form a source of their own, last in order. Rows that
repeat an id toss the same coin. Sources without words get rate 0. An empty table mixes to an empty
table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusaudit.llm.store import packed, small, unpacked, written

WORD = r"[^\x20\x09-\x0D]+"
COIN_BITS = 52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def coin(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, COIN_BITS // 4), 16, 10).cast("long") / F.lit(float(2**COIN_BITS))


def _ranked(totals: DataFrame) -> tuple[DataFrame, int]:
    """Sources with their position (from 0) in code point order, null last, and how many they are.
    The order is kept per range partition; only counts per partition meet in one place."""
    ordered = totals.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ordered = written(ordered, "mix-sources")
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    ranked = ordered.join(starts, "part").select(
        "source", "source_size", (F.col("start") + within - 1).alias("position")
    )
    return ranked, ordered.count()


def source_targets(
    sized: DataFrame, weights: Sequence[float], share: float, cap: float
) -> tuple[DataFrame, int]:
    """(source, source_size, target) and the number of sources, from rows (source, size).

    Targets share ``share`` times all sizes in proportion to the weights. One that exceeds ``cap``
    times its source's size stops there, and the rest is shared again until none is above.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked, n_sources = _ranked(totals)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    rows = written(
        ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("cap")),
        "mix-weights",
    )
    all_sizes, all_weights = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    pool = share * (all_sizes or 0)
    level = pool / all_weights if all_weights else 0.0
    n_capped = 0
    while True:  # every round caps at least one more source
        above = F.col("weight") * F.lit(level) > F.col("cap")
        n, at_cap, free = rows.agg(
            F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if n == n_capped:
            break
        n_capped = n
        level = (pool - at_cap) / free if free else float("inf")
    target = F.least(F.col("weight") * F.lit(level), F.col("cap")) if level != float("inf") else F.col("cap")
    return rows.select("source", "source_size", target.cast("double").alias("target")), n_sources


def repetitions(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """One row per document: (row, doc_id, size, source_size, target, copies); ``row`` holds the
    document's columns. The join on the source carries a table of one row per source, which is
    broadcast up to a counted bound; beyond it adaptive execution splits a hot source."""
    keyed = packed(docs, doc_id=docs["doc_id"], source=docs["source"], size=word_count(docs["text"]))
    targets, n_sources = source_targets(keyed.select("source", "size"), weights, share, cap)
    targets = small(targets.withColumnRenamed("source", "target_source"), n_sources)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = coin(F.col("doc_id"), seed) < rate - F.floor(rate)
    copies = F.floor(rate) + extra.cast("long")
    return keyed.join(targets, keyed["source"].eqNullSafe(targets["target_source"])).select(
        "row", "doc_id", "size", "source_size", "target", copies.alias("copies")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as its copies say, in the columns of ``docs``."""
    repeated = repetitions(docs, **options)
    each = repeated.filter("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    )
    return unpacked(each, docs.columns)
