"""Exact deduplication with native expressions.

Rows are grouped by a 128-bit hash of their normalised text. Hashes that occur once are done; the
texts behind the others are compared byte by byte, by grouping on hash and text, so that two texts
with the same hash stay apart. Only rows of repeated hashes ever send their text through a shuffle,
and partial aggregation sends one row per text and task, however large a group of copies is.

A null text counts as empty; empty texts are equal. Rows without an id never stay if a row with an
id is in their group. Rows that repeat both id and text count once each in ``group_size``; all are
marked as kept in ``mark_copies`` and one of them is returned by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.store import packed, small, unpacked, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does the same to a text of ASCII characters, and faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def mark_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per document: (row, doc_id, keep_id, group_size, kept, n_same, text_sha256).

    ``keep`` names the id that stays in a group, ``n_same`` counts the rows that carry it there.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    norm = lower_ascii(docs["text"])
    hashes = docs.select(F.unhex(F.md5(norm)).alias("hash"))
    repeated = written(hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "dedup-hashes")
    n_repeated = repeated.count()
    texts = docs.select(docs["doc_id"].alias("doc_id"), F.unhex(F.md5(norm)).alias("hash"), norm.alias("norm"))
    suspects = texts.join(small(repeated, n_repeated), "hash", "left_semi")
    ids = suspects.groupBy("hash", "norm", "doc_id").agg(F.count("*").alias("n"))
    classes = ids.groupBy("hash", "norm").agg(
        best("doc_id").alias("keep_id"), F.sum("n").alias("group_size"),
        best(F.struct("doc_id", "n")).alias("top") if keep == "largest"
        else F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("top"),
    )
    classes = written(
        classes.select("hash", "norm", "keep_id", "group_size", F.coalesce("top.n", "group_size").alias("n_same")),
        "dedup-classes",
    )
    per_hash = classes.groupBy("hash").agg(
        F.count("*").alias("n_texts"),
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.max("n_same").alias("n_same"),
    )
    single = per_hash.filter("n_texts = 1").drop("n_texts")
    collided = classes.join(per_hash.filter("n_texts > 1").select("hash"), "hash", "left_semi")
    # Classes of colliding hashes are told apart by their text. There are hardly ever any; the
    # text of a document is looked at only if its hash collides.
    collided = collided.select(
        F.col("hash").alias("c_hash"), "norm", F.col("keep_id").alias("c_keep"),
        F.col("group_size").alias("c_size"), F.col("n_same").alias("c_same"),
    )
    keyed = packed(docs, doc_id=docs["doc_id"], hash=F.unhex(F.md5(norm)), text_sha256=F.sha2(norm, 256))
    joined = keyed.join(small(single, n_repeated), "hash", "left")
    if collided.isEmpty():
        keep_id, size, same = F.col("keep_id"), F.col("group_size"), F.col("n_same")
    else:
        own = lower_ascii(F.col("row.text"))
        joined = joined.join(
            collided, (joined["hash"] == collided["c_hash"]) & (own == collided["norm"]), "left"
        )
        keep_id, size, same = F.coalesce("keep_id", "c_keep"), F.coalesce("group_size", "c_size"), F.coalesce("n_same", "c_same")
    alone = size.isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(keep_id)
    return joined.select(
        "row",
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce(size, F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.coalesce(same, F.lit(1).cast("long")).alias("n_same"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row of every group of equal texts, in the columns of ``docs``."""
    kept = mark_copies(docs, keep).filter("kept")
    once = kept.filter("n_same = 1").select("row")
    # Rows that repeat id and text: one of them, taken before the shuffle wherever they meet.
    again = kept.filter("n_same > 1").groupBy("doc_id", "text_sha256").agg(F.first("row").alias("row"))
    return unpacked(once.unionByName(again.select("row")), docs.columns)
