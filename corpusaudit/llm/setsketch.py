"""Near-duplicate detection by SetSketch registers.

A document's set holds its distinct word shingles, hashed to 64 bits. A register is the truncated
logarithm (base b close to 1) of the smallest of exponentially distributed hashes, so registers of a
union are the maxima of registers, and equal registers tell similar sets. Bands of registers propose
candidates, the joint likelihood of the registers that are equal, smaller and larger discards most
of the dissimilar ones, and links are confirmed on full sets.

No pairs of a bucket are listed. Documents with equal sets are one class. Every class is first
compared with the hub of its bucket (the class that shares most buckets with others), which connects
groups of copies; buckets that still hold several components are then compared exactly in blocks of
bounded size, from which only a spanning forest of confirmed links is returned.

Null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows
without an id are linked with nothing. Rows that repeat an id belong together, whatever their texts: each text is a
class of its own and finds its own links, and the id joins them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.llm.bpe import as_bytes
from corpusaudit.llm.components import components
from corpusaudit.llm.store import give_back, packed, small, unpacked, written

BASE, RATE, LIMIT = 1.001, 20.0, 65534  # registers of 16 bits
ROWS_PER_BAND = 4
MISS = 1e-5  # chance that a pair at the threshold shares no band
SIGMAS = 5.0  # estimates this far below the threshold are discarded
BLOCK = 256
SETS_AT_ONCE = 1000
CACHED_WORDS = 100_000


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS_PER_BAND)))


@lru_cache(maxsize=1)
def _word_hashes() -> dict[bytes, int]:
    return {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of lower-cased (A-Z) words; one of all words if there
    are fewer than ``width``."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _word_hashes()
    if len(known) > CACHED_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    mixed = np.full(n, min(width, len(h)), np.uint64)
    for i in range(min(width, len(h))):
        mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(mixed)


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SetSketch registers (n, m) of non-empty sets."""
    out = np.empty((len(sets), m), np.uint64)
    seeds = np.random.default_rng(20210101).integers(1, 2**63, m, dtype=np.uint64)
    begin = 0
    while begin < len(sets):  # stretches that stay in the cache
        stop, size = begin, 0
        while stop < len(sets) and (size == 0 or size + len(sets[stop]) < 30_000):
            size += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[begin:stop])
        at = np.cumsum([0] + [len(s) for s in sets[begin : stop - 1]])
        for i in range(m):
            x = (flat ^ seeds[i]) * np.uint64(0x9FB21C651E98DF25)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            out[begin:stop, i] = np.minimum.reduceat(x, at)
        begin = stop
    least = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**64) / RATE
    least = np.maximum(least, 1e-300)
    return np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def joint_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity from registers (.., m) and set sizes, by bisection on the
    derivative of the joint log-likelihood."""
    more, less, m = (a > b).sum(-1), (a < b).sum(-1), a.shape[-1]
    same = m - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    c = (BASE - 1) / BASE

    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.clip(x, 0, 1) * c) / math.log(BASE), 1e-12)

    def slope(x: np.ndarray) -> np.ndarray:  # of p
        return c / (1 - np.clip(x, 0, 1) * c) / math.log(BASE)

    low, high = np.zeros(np.shape(same)), np.minimum(u / v, v / u)
    for _ in range(18):
        j = (low + high) / 2
        x, y = u - v * j, v - u * j
        rest = np.maximum(1 - p(x) - p(y), 1e-12)
        rise = -more * v * slope(x) / p(x) - less * u * slope(y) / p(y) + same * (v * slope(x) + u * slope(y)) / rest
        low, high = np.where(rise > 0, j, low), np.where(rise > 0, high, j)
    return (low + high) / 2


def floor_of(percent: int, m: int) -> float:
    t = percent / 100
    return t - SIGMAS * math.sqrt(t * (1 - t) / m)


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch, buckets) of every row."""
    n_bands = bands_for(percent)
    m = n_bands * ROWS_PER_BAND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                batch = whole.slice(begin, 2000)
                sets = [shingles(t, width) for t in as_bytes(batch.column(1))]
                full = [i for i, s in enumerate(sets) if len(s)]
                regs = registers([sets[i] for i in full], m)
                sketch: list = [None] * len(sets)
                digest: list = [None] * len(sets)
                buckets: list = [None] * len(sets)
                for i, r in zip(full, regs):
                    sketch[i] = r.tobytes()
                    digest[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    buckets[i] = [xxhash.xxh3_64_intdigest(r[k * ROWS_PER_BAND : (k + 1) * ROWS_PER_BAND].tobytes(), seed=k) - 2**63 for k in range(n_bands)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                        pa.array(sketch, pa.binary()), pa.array(buckets, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "digest", "sketch", "buckets"],
                )
        _word_hashes().clear()  # a worker outlives the stage
        give_back()

    schema = "doc_id long, n_shingles long, digest binary, sketch binary, buckets array<long>"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, schema)


def _shingle_sets(docs: DataFrame, nodes: DataFrame, n_nodes: int, width: int) -> DataFrame:
    """(node, items) of the classes that take part in a comparison. Texts are read again instead of
    storing all sets; only texts of ``nodes`` leave the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in (b.slice(i, SETS_AT_ONCE) for b in batches for i in range(0, b.num_rows, SETS_AT_ONCE)):
            sets = [shingles(t, width).astype("<u8").tobytes() for t in as_bytes(batch.column(1))]
            # a repeated id may carry other texts than the one that stands for the class
            own = [xxhash.xxh3_128_digest(s) == d for s, d in zip(sets, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "items"]).filter(pa.array(own))
        _word_hashes().clear()
        give_back()

    rows = docs.select(docs["doc_id"].cast("long").alias("first_id"), docs["text"].alias("text"))
    wanted = rows.join(small(nodes.select("node", "first_id", "digest"), n_nodes), "first_id").select("node", "text", "digest")
    return wanted.mapInArrow(run, "node long, items binary").groupBy("node").agg(F.first("items").alias("items"))


def _confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b, a_sketch, b_sketch, a_items, b_items) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # sets are read where they lie in the batch, since those of long texts are large
            sets = [[np.frombuffer(v.as_buffer(), "<u8") for v in batch.column(c)] for c in (2, 3)]
            keep = [i for i, (x, y) in enumerate(zip(*sets)) if _similar(x, y, percent)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return pairs.select("a", "b", "a_items", "b_items").mapInArrow(run, "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


@F.pandas_udf(T.DoubleType())
def _estimate(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    if len(a) == 0:
        return pd.Series([], dtype=float)
    x = np.stack([np.frombuffer(r, np.uint16) for r in a])
    y = np.stack([np.frombuffer(r, np.uint16) for r in b])
    return pd.Series(joint_jaccard(x, y, n_a.to_numpy(float), n_b.to_numpy(float)))


def _compare_blocks(rows: list[dict], left: int, right: int, percent: int) -> Iterator[tuple[int, int]]:
    """Confirmed links between different components of two blocks (or within one) of a bucket."""
    regs = np.stack([np.frombuffer(r["sketch"], np.uint16) for r in rows])
    sizes = np.array([r["n_shingles"] for r in rows], float)
    parent = {r["component"]: r["component"] for r in rows}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    side = np.array([r["side"] for r in rows])
    a_rows = np.flatnonzero(side == left)
    b_rows = np.flatnonzero(side == right)
    least = floor_of(percent, regs.shape[1])
    items: dict[int, np.ndarray] = {}
    for a in a_rows.tolist():
        others = b_rows[b_rows > a] if left == right else b_rows
        mine = root(rows[a]["component"])
        others = np.array([b for b in others.tolist() if root(rows[b]["component"]) != mine], np.int64)
        if len(others) == 0:
            continue
        likely = joint_jaccard(regs[a][None], regs[others], sizes[a], sizes[others]) >= least
        for b in others[likely].tolist():
            if root(rows[b]["component"]) == root(rows[a]["component"]):
                continue
            for i in (a, b):
                if i not in items:
                    items[i] = np.frombuffer(rows[i]["items"], "<u8")
            if _similar(items[a], items[b], percent):
                parent[root(rows[b]["component"])] = root(rows[a]["component"])
                yield rows[a]["node"], rows[b]["node"]


def _links(docs: DataFrame, width: int, percent: int, rows: DataFrame) -> DataFrame:
    """Confirmed links between classes that connect all that is linked, as pairs (a, b) of the smallest ids
    of their classes. ``rows`` are stored sketches. Ids do not number the classes, as several may
    share one; their numbers are made once and stored."""
    classes = rows.filter("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"),
        F.first("sketch").alias("sketch"), F.first("buckets").alias("buckets"),
    )
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    members = classes.select("node", F.explode("buckets").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(members.join(crowded, "bucket"), "near-members")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("h"))
    stars = members.join(hubs.select("bucket", (-F.col("h.minus")).alias("hub")), "bucket")
    stars = stars.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    involved = weight.select("node").join(classes, "node").select("node", "first_id", "digest", "n_shingles", "sketch")
    involved = written(involved, "near-involved")
    n_nodes = involved.count()
    sets = written(_shingle_sets(docs, involved, n_nodes, width).join(involved.drop("digest", "first_id"), "node"), "near-sets")

    def side(name: str) -> DataFrame:
        return involved.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"{name}_sketch"))

    m = bands_for(percent) * ROWS_PER_BAND
    likely = stars.join(side("a"), "a").join(side("b"), "b").filter(
        _estimate("a_sketch", "b_sketch", "n_a", "n_b") >= floor_of(percent, m)
    )
    pairs = likely.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("a_items")), "a")
    pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("b_items")), "b")
    first = written(_confirm(pairs, percent), "near-links")
    links = first.unionByName(_rest(members, sets, components(first), percent))
    for end in ("a", "b"):
        own = involved.select(F.col("node").alias(end), F.col("first_id").alias(f"{end}_id"))
        links = links.join(own, end)
    return links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).filter("a <> b")


def _rest(members: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets that hold several components, compared exactly block by block."""
    own = F.coalesce("component", "node")
    open_rows = members.join(found, "node", "left").select("bucket", "node", "n", own.alias("component"))
    open_buckets = open_rows.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    rows = open_rows.join(open_buckets, "bucket")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.greatest(blocks, F.lit(1))).cast("int")
    rows = rows.withColumn("side", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1))
    )
    rows = rows.select(
        F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other")).alias("task"), "bucket",
        F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"), "node", "component", "side",
    )
    rows = rows.join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> pa.RecordBatch:
            links = list(_compare_blocks(held, key[1], key[2], percent)) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                for r in whole.slice(begin, 500).to_pylist():
                    now = (r["bucket"], r["left"], r["right"])
                    if now != key:
                        if held:
                            yield flush()
                        key, held = now, []
                    held.append(r)
        if held:
            yield flush()
        held = []
        give_back()

    dealt = rows.repartition("task").sortWithinPartitions("task", "bucket", "left", "right")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for every row of ``docs``. Documents are
    linked if their sets share at least ``percent`` of their union."""
    rows = written(sketches(docs, width, percent), "near-sketches")
    links = _links(docs, width, percent, rows)
    same = rows.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("b"))
    copies = rows.join(same, "digest").select(F.col("doc_id").alias("a"), "b").filter("a <> b")
    found = components(links.unionByName(copies))
    out = rows.join(found, rows["doc_id"] == found["node"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of every group, in the columns of ``docs``: the one with the smallest id."""
    dropped = written(near_duplicates(docs, width, percent).filter("not kept").select("doc_id").distinct(), "near-dropped")
    keyed = packed(docs, doc_id=docs["doc_id"].cast("long"))
    return unpacked(keyed.join(small(dropped, dropped.count()), "doc_id", "left_anti"), docs.columns)
