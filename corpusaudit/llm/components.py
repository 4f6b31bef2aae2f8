"""Connected components by large-star and small-star steps.

Every step is an aggregate and a join; a node with very many neighbours is reduced before the
shuffle and its join is split by adaptive execution. Edges are written between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.store import written


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """edges: (u, v) with v < u. Links the neighbours of every node to the smallest of them."""
    if both_ways:  # large star: the larger neighbours and the node itself go to the minimum
        ways = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        ways = ways.select("e.u", "e.v")
    else:
        ways = edges
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = ways.join(least, "u")
    if both_ways:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # small star: the smaller neighbours and the node itself
        own = least.select("u", F.col("m").alias("v"))
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge (a, b)."""
    now = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = state(now)
    while before[0]:
        now = written(_star(_star(now, True), False), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
