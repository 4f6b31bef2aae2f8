"""Binary output of token ids: Simple-8b words in blocks, stored as a table of blocks.

A 64-bit word holds a selector in its top four bits and as many ids of equal width as fit below.
Ids of more than 60 bits escape: the word stream holds 0 and the block lists position and value.
Blocks hold whole documents with their offsets, so each is decoded by itself with array operations.

Documents are ordered by (doc_id, hash of the text, text), a missing id first; repeated ids are
neighbours and identical rows interchangeable. Null and empty texts hold the end id alone. The order
is by range partition, so no task sees more than its range; shard numbers follow the ranges, and
only one total per shard is summed in one place. A document has to fit into a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusaudit.llm.bpe import ID, as_bytes, encoder

# Ids per word and bits per id of selectors 2 to 15; 0 and 1 are not used.
SELECTORS = (
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
    (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
COUNTS = np.array([0, 0] + [c for c, _ in SELECTORS], np.int64)
BLOCK_IDS = 1 << 17
BYTES_AT_ONCE = 4_000_000  # of texts whose distinct words are looked up together
LIMITS = np.array([1 << b for _, b in SELECTORS], np.uint64)
NARROWEST = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)


def selectors_of(ids: np.ndarray) -> np.ndarray:
    """For each id the narrowest selector whose word can begin with it: as many ids from there on as it
    holds (or all that are left) are narrow enough. Windows of each length are made of two of the length before."""
    n, most = len(ids), SELECTORS[0][0]
    widest = np.zeros(n + most, np.uint8)
    widest[:n] = NARROWEST[np.minimum(ids, np.uint64((1 << 16) - 1)).astype(np.int64)]
    large = np.flatnonzero(ids >> np.uint64(16))
    widest[large] = np.searchsorted(LIMITS, ids[large], "right")
    best, length = np.full(n, len(SELECTORS) - 1, np.int64), 1
    for k in range(len(SELECTORS) - 2, -1, -1):  # narrower selectors hold more and win
        more = SELECTORS[k][0] - length
        widest[:-more] = np.maximum(widest[:-more], widest[more:])
        length += more
        best[widest[:n] <= k] = k
    return best


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, positions of escapes, values of escapes) of unsigned integers."""
    ids = ids.astype(np.uint64)
    at = np.flatnonzero(ids >> np.uint64(60))
    values = ids[at]
    ids[at] = 0
    n = len(ids)
    best = selectors_of(ids)
    steps = COUNTS[best + 2].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts, np.int64)
    chosen = best[starts]
    padded = np.append(ids, np.zeros(60, np.uint64))
    words = (chosen + 2).astype(np.uint64) << np.uint64(60)
    for k in np.unique(chosen).tolist():
        count, bits = SELECTORS[k]
        rows = np.flatnonzero(chosen == k)
        for j in range(count):
            words[rows] |= padded[starts[rows] + j] << np.uint64(j * bits)
    return words, at, values


def unpack(words: np.ndarray, n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    selectors = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selectors])
    starts = ends - COUNTS[selectors]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selectors).tolist():
        count, bits = SELECTORS[s - 2]
        rows = np.flatnonzero(selectors == s)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count):
            out[starts[rows] + j] = (words[rows] >> np.uint64(j * bits)) & mask
    out = out[:n]
    out[at] = values
    return out


BLOCKS = (
    "shard int, block int, start long, n_ids long, doc_ids array<long>, lengths array<int>, "
    "words binary, escaped_at binary, escaped binary"
)


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int) -> None:
    """Encodes ``docs`` (doc_id, text), appends ``end_id`` to each, and writes blocks to ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(path), np.array([end_id], ID).tobytes()
        shard = TaskContext.get().partitionId()
        block = start = size = 0
        names: list = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), ID)
            words, at, values = pack(ids)
            rows = [
                [shard], [block], [start], [len(ids)], [names], [[len(i) // 4 for i in held]],
                [words.astype("<u8").tobytes()], [at.astype("<i8").tobytes()], [values.astype("<u8").tobytes()],
            ]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 3]
            columns = [pa.array(r, k) for r, k in zip(rows, kinds)]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            ids = code.encode(as_bytes(batch.column(1)), BYTES_AT_ONCE)
            for name, i in zip(batch.column(0).to_pylist(), ids):
                names.append(name)
                held.append(i + end)
                size += len(i) // 4 + 1
                if size >= BLOCK_IDS:
                    yield flush()
                    block, start, size, names, held = block + 1, start + size, 0, [], []
        if held:
            yield flush()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    ordered.mapInArrow(run, BLOCKS).write.parquet(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the blocks: ``start``
    counts the ids of all documents before it, the checksum is over the ids as little-endian
    unsigned 32-bit integers."""
    blocks = spark.read.schema(BLOCKS).parquet(out)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("shard", F.coalesce(before, F.lit(0).cast("long")).alias("base"))
    placed = blocks.join(F.broadcast(bases), "shard")  # a row per written shard
    placed = placed.select((F.col("base") + F.col("start")).alias("start"), "n_ids", "doc_ids", "lengths", "words", "escaped_at", "escaped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                at, values = np.frombuffer(b["escaped_at"], "<i8"), np.frombuffer(b["escaped"], "<u8")
                ids = unpack(np.frombuffer(b["words"], "<u8"), b["n_ids"], at, values).astype(ID).tobytes()
                stops = np.cumsum([0, *b["lengths"]]).tolist()
                sums = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(stops, stops[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b["doc_ids"], pa.int64()),
                        pa.array([b["start"] + s for s in stops[:-1]], pa.int64()),
                        pa.array(b["lengths"], pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
