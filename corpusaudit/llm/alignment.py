"""Alignment of two tokenizers over the same bytes, and how often their ids meet in a corpus.

Both encode a space and the text. Byte offsets where a token of A and one of B end cut the tokens into
groups. Two tokens are linked if their bytes overlap; as every byte between two neighbouring ends lies in
one token of each, links are the stretches between the ends of either side.

A document of more than ``CHUNK`` bytes is cut into byte ranges that are encoded in different tasks. A
range owns what begins at its first safe cut, which may be another place for A than for B: the tokens up
to the first end that both share are an open prefix, those behind the last one an open suffix, and the
groups between are closed. Such fragments form a monoid: composing two closes what the suffix of one
and the prefix of the other share. ``FAN`` neighbours are composed at a time, round by round, until a document is one
fragment. Shorter documents are aligned where they are read.

Counts of id pairs are summed over the corpus in two steps. Each block of documents numbers its
distinct pairs and stores its links by these numbers, bucketed by block; only a pair's number, code and
count per block is shuffled to be summed, and comes back to its block, which is not shuffled again.
So a pair that is in a third of all links sends one row per block.

Null and empty texts, and texts that the tokens of a side do not give back byte for byte, have no
tokens. Every row of the input gives one row, repeated rows too. A document has to fit into a task
in the end, as its digest is over all of it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.bpe import BYTE_ALPHABET
from corpusaudit.llm.store import fresh_name, give_back, written
from corpusaudit.sources.state import new_dir

CHUNK = 1 << 16  # bytes of a long document per range
FAN = 8
BLOCK = 3_000_000  # bytes aligned at once; a block numbers its own pairs
TEXTS_AT_ONCE = 100  # whose ids a library returns as lists at once
# Fixed value: the published splitting pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Both libraries' tables of letters, digits and spaces agree below this character; others go to the
# library that reads the vocabulary file.
SETTLED = re.compile("[^\x00-ɏ]")
CUT_A = re.compile(rb"(?<=[\x21-\x7e]) (?=[\x21-\x7e])")  # a word begins with its one space
CUT_B = re.compile(rb"(?<=[\x09-\x0d\x21-\x7e]) (?=.)", re.DOTALL)  # no piece holds a space behind another character


class ByteTokens:
    """A byte-level vocabulary: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model = config["model"]
        byte_of = {c: b for b, c in BYTE_ALPHABET.items()}
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        first = len(model["vocab"]) - len(merges)
        plain = config["normalizer"] is None and config["pre_tokenizer"].get("use_regex") and not config["pre_tokenizer"].get("add_prefix_space")
        # ids in the order of the merges serve as ranks
        if plain and all(model["vocab"][a + b] == first + i for i, (a, b) in enumerate(merges)):
            ranks = {b: i for i, b in enumerate(self.bytes)}
            self.quick = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        else:
            self.quick = None

    def encode(self, texts: list[str]) -> list[list[int]]:
        slow = [i for i, t in enumerate(texts) if self.quick is None or SETTLED.search(t)]
        found = {i: e.ids for i, e in zip(slow, self.library.encode_batch([texts[i] for i in slow], add_special_tokens=False))}
        return [found[i] if i in found else self.quick.encode_ordinary(t) for i, t in enumerate(texts)]


class PieceTokens:
    """A vocabulary of pieces, which puts a space before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace("▁", " ").encode())
        if any(re.search("[^▁]▁", self.library.id_to_piece(i)) for i in range(len(self.bytes))):
            raise ValueError(f"{path}: a piece holds a space behind another character, so ranges have no safe cut")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode([t[1:] for t in texts], num_threads=1)


class Pair:
    """Two tokenizers, with tables of the lengths of tokens and of how ids are written."""

    def __init__(self, a: str, b: str):
        self.sides = ByteTokens(a), PieceTokens(b)
        self.widths = [np.array([len(t) for t in s.bytes], np.int64) for s in self.sides]
        n_a, n_b = (len(w) for w in self.widths)
        self.n_a, self.n_b = n_a, n_b
        # ids followed by a comma, and at the end of their side of a group
        self.written = [b"%d," % i for i in range(n_a)] + [b"%d|" % i for i in range(n_a)]
        self.written += [b"%d," % i for i in range(n_b)] + [b"%d;" % i for i in range(n_b)]

    def encode(self, side: int, texts: list[bytes]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of texts, each of which begins with a space, and whether they give back its bytes."""
        s, ids, same = self.sides[side], [], []
        for part in (texts[i : i + TEXTS_AT_ONCE] for i in range(0, len(texts), TEXTS_AT_ONCE)):
            lists = s.encode([t.decode("utf-8") for t in part])
            same += [b"".join(map(s.bytes.__getitem__, i)) == t for i, t in zip(lists, part)]
            ids += [np.array(i, np.int64) for i in lists]
        return ids, same

    def groups(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> Groups:
        """Groups and links of tokens whose sides begin and end together; ends count from there."""
        size = int(a_ends[-1]) if len(a_ends) else 0
        mark = np.zeros(size + 1, np.uint8)
        mark[a_ends] = 1
        mark[b_ends] |= 2
        at = np.flatnonzero(mark)
        kind = mark[at]
        is_a, is_b, both = (kind & 1).astype(np.int64), (kind >> 1).astype(np.int64), kind == 3
        codes = (a[np.cumsum(is_a) - is_a] << 32) | b[np.cumsum(is_b) - is_b] if len(at) else np.zeros(0, np.int64)
        last_a, last_b = mark[a_ends] == 3, mark[b_ends] == 3
        # tokens of either side up to and with each group
        till_a, till_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate(([0], till_b))[group_a]] = a + self.n_a * last_a
        order[np.arange(len(b)) + (till_a[group_b] if len(b) else 0)] = 2 * self.n_a + b + self.n_b * last_b
        return Groups(at[both], at, codes, order, till_a, till_b)

    def text(self, order: np.ndarray) -> bytes:
        return b"".join(map(self.written.__getitem__, order.tolist()))


@dataclass
class Groups:
    ends: np.ndarray  # where groups end
    stops: np.ndarray  # where links end
    codes: np.ndarray  # the id pair of each link
    order: np.ndarray  # how tokens are written, group by group
    till_a: np.ndarray  # tokens up to and with each group
    till_b: np.ndarray


@lru_cache(maxsize=2)
def pair(a: str, b: str) -> Pair:
    return Pair(a, b)


EMPTY = np.zeros(0, np.int64)


@dataclass
class Fragment:
    """A byte range of a document: tokens before the first end that both sides share, closed groups,
    and tokens behind the last such end. Offsets count from the start of the document; ``first`` and
    ``last`` are -1 if no end is shared, and all tokens are in the prefix then."""

    a0: int
    b0: int
    first: int
    last: int
    n_a: int
    n_b: int
    n_groups: int
    good: bool
    head_a: np.ndarray
    head_a_ends: np.ndarray
    head_b: np.ndarray
    head_b_ends: np.ndarray
    tail_a: np.ndarray
    tail_a_ends: np.ndarray
    tail_b: np.ndarray
    tail_b_ends: np.ndarray
    codes: np.ndarray
    text: bytes


ARRAYS = [f.name for f in fields(Fragment) if f.name[:4] in ("head", "tail", "code")]
NUMBERS = [f.name for f in fields(Fragment) if f.name not in ARRAYS and f.name not in ("text", "good")]
FRAGMENT = ", ".join([f"{n} long" for n in NUMBERS] + ["good boolean"] + [f"{n} binary" for n in [*ARRAYS, "text"]])


def fragment(code: Pair, a0: int, b0: int, a, a_ends, b, b_ends, good: bool = True) -> Fragment:
    """The fragment of tokens whose sides begin at a0 and b0."""
    shared = np.intersect1d(np.append(a_ends, a0), np.append(b_ends, b0))
    counts = len(a), len(b)
    if len(shared) == 0:
        return Fragment(a0, b0, -1, -1, *counts, 0, good, a, a_ends, b, b_ends, EMPTY, EMPTY, EMPTY, EMPTY, EMPTY, b"")
    first, last = int(shared[0]), int(shared[-1])
    i, j = np.searchsorted(a_ends, (first, last), "right")
    k, m = np.searchsorted(b_ends, (first, last), "right")
    closed = code.groups(a[i:j], b[k:m], a_ends[i:j] - first, b_ends[k:m] - first)
    return Fragment(
        a0, b0, first, last, *counts, len(closed.ends), good, a[:i], a_ends[:i], b[:k], b_ends[:k],
        a[j:], a_ends[j:], b[m:], b_ends[m:], closed.codes, code.text(closed.order),
    )


def compose(code: Pair, f: Fragment, g: Fragment) -> Fragment:
    """``f`` followed by ``g``. Associative, since ends shared by both sides do not depend on the order
    in which neighbours are composed."""
    part = "tail" if f.last >= 0 else "head"
    open_f = [getattr(f, f"{part}_{n}") for n in ("a", "a_ends", "b", "b_ends")]
    open_g = [g.head_a, g.head_a_ends, g.head_b, g.head_b_ends]
    start = (f.last, f.last) if f.last >= 0 else (f.a0, f.b0)
    m = fragment(code, *start, *[np.concatenate(x) for x in zip(open_f, open_g)])
    heads = f if f.last >= 0 else m
    tails = g if g.last >= 0 else m
    return Fragment(
        f.a0, f.b0, f.first if f.last >= 0 else m.first, g.last if g.last >= 0 else m.last,
        f.n_a + g.n_a, f.n_b + g.n_b, f.n_groups + m.n_groups + g.n_groups, f.good and g.good,
        heads.head_a, heads.head_a_ends, heads.head_b, heads.head_b_ends, tails.tail_a, tails.tail_a_ends, tails.tail_b, tails.tail_b_ends,
        np.concatenate((f.codes, m.codes, g.codes)), f.text + m.text + g.text,
    )


def _row(f: Fragment) -> dict:
    out = {n: int(getattr(f, n)) for n in NUMBERS} | {"good": bool(f.good), "text": f.text}
    return out | {n: np.ascontiguousarray(getattr(f, n)).astype("<i8").tobytes() for n in ARRAYS}


def _fragment(row: dict) -> Fragment:
    return Fragment(**{n: row[n] for n in [*NUMBERS, "good", "text"]}, **{n: np.frombuffer(row[n], "<i8") for n in ARRAYS})


def cuts(whole: bytes, size: int) -> list[tuple[int, int]]:
    """Where the ranges of a document begin, for A and for B: the first safe cut at or after every
    multiple of ``size``. The end comes last."""
    found = [(0, 0)]
    for start in range(size, len(whole), size):
        hits = CUT_A.search(whole, start), CUT_B.search(whole, start)
        found.append(tuple(max(h.start() if h else len(whole), before) for h, before in zip(hits, found[-1])))
    return [*found, (len(whole), len(whole))]


def encode_range(code: Pair, a0: int, a1: int, b0: int, b1: int, part: bytes, at: int) -> Fragment:
    """The fragment of a range: A's tokens of bytes a0 to a1, B's of b0 to b1. ``part`` holds the
    document's bytes from ``at`` on."""
    sides, good = [], True
    for side, (start, stop) in enumerate(((a0, a1), (b0, b1))):
        ids, same = code.encode(side, [part[start - at : stop - at]] if stop > start else [])
        ids = ids[0] if ids else EMPTY
        good = good and all(same)
        sides += [ids, start + np.cumsum(code.widths[side][ids])]
    return fragment(code, a0, b0, *sides, good)


BLOCKS = (
    "block long, doc_ids array<long>, counts binary, digests array<string>, groups array<string>, stops binary, links binary, "
    "codes array<long>, times array<int>"
)


class Blocks:
    """Packs aligned documents into rows of ``BLOCKS``. ``counts`` holds n_a, n_b, n_groups and n_links of
    each document, ``stops`` where its links end; ``links`` are numbers into ``codes``."""

    def __init__(self, kind: int, keep_groups: bool):
        # one number per block: the task that makes it, and its place there
        self.number = (TaskContext.get().partitionId() << 24) * 2 + kind
        self.keep = keep_groups

    def row(self, ids: list, counts: np.ndarray, texts: list[bytes | None], codes: np.ndarray) -> pa.RecordBatch:
        import zstandard

        own, which, times = np.unique(codes, return_inverse=True, return_counts=True)
        rank = np.empty(len(own), np.int64)
        order = np.argsort(-times, kind="stable")  # frequent pairs get small numbers, which pack better
        rank[order] = np.arange(len(own))
        links = zstandard.ZstdCompressor(level=1).compress(rank[which].astype("<u4").tobytes())
        digests = [hashlib.sha256(t[:-1]).hexdigest() if t is not None else "" for t in texts]
        groups = [t[:-1].decode() if t is not None else "" for t in texts] if self.keep else []
        cells = [
            self.number, ids, counts.astype("<i8").tobytes(), digests, groups, np.cumsum(counts[:, 3]).astype("<i8").tobytes(),
            links, own[order], times[order].astype(np.int32),
        ]
        self.number += 2
        kinds = [
            pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), pa.binary(),
            pa.list_(pa.int64()), pa.list_(pa.int32()),
        ]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])


def _short(rows: DataFrame, a: str, b: str, keep_groups: bool) -> DataFrame:
    """Blocks of the documents that are aligned whole."""

    def align(code: Pair, blocks: Blocks, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        at = [i for i, t in enumerate(texts) if t]
        whole = [b" " + texts[i] for i in at]
        (ids_a, good_a), (ids_b, good_b) = (code.encode(side, whole) for side in (0, 1))
        kept = [k for k in range(len(at)) if good_a[k] and good_b[k]]
        flat = [np.concatenate([EMPTY, *[x[k] for k in kept]]) for x in (ids_a, ids_b)]
        g = code.groups(*flat, *[np.cumsum(w[x]) for w, x in zip(code.widths, flat)])
        stop = np.cumsum([len(whole[k]) for k in kept])
        counts, out = np.zeros((len(texts), 4), np.int64), [None] * len(texts)
        n_groups = np.searchsorted(g.ends, stop, "right")
        n_links = np.searchsorted(g.stops, stop, "right")
        n_tokens = np.concatenate(([0], g.till_a + g.till_b))[n_groups]
        before = np.zeros(3, np.int64)
        for k, x, y, z in zip(kept, n_groups.tolist(), n_links.tolist(), n_tokens.tolist()):
            i = at[k]
            counts[i] = len(ids_a[k]), len(ids_b[k]), x - before[0], y - before[1]
            out[i] = code.text(g.order[before[2] : z])
            before = x, y, z
        return blocks.row(ids, counts, out, g.codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, blocks = pair(a, b), Blocks(0, keep_groups)
        ids, texts, size = [], [], 0
        for batch in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= BLOCK:
                    yield align(code, blocks, ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield align(code, blocks, ids, texts)
        del ids, texts
        give_back()

    return rows.select("doc_id", "text").mapInArrow(run, BLOCKS)


def _long(rows: DataFrame, a: str, b: str, keep_groups: bool) -> DataFrame:
    """Blocks of the documents that are aligned in ranges, a document each."""
    size = CHUNK

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            row = batch.to_pylist()[0]
            whole = b" " + row["text"]
            at = cuts(whole, size)
            for nr, ((a0, b0), (a1, b1)) in enumerate(zip(at, at[1:])):
                begin, end = min(a0, b0), max(a1, b1)
                cells = [row["key"], row["doc_id"], nr, len(at) - 1, a0, a1, b0, b1, begin, whole[begin:end]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c], pa.binary() if isinstance(c, bytes) else pa.int64()) for c in cells], names=RANGE.replace(" long", "").replace(" binary", "").split(", ")
                )

    RANGE = "key long, doc_id long, nr long, n long, a0 long, a1 long, b0 long, b1 long, begin long, part binary"
    keyed = "key long, doc_id long, nr long, n long, " + FRAGMENT
    names = [c.split()[0] for c in keyed.split(", ")]
    kinds = [pa.binary() if c.endswith("binary") else pa.bool_() if c.endswith("boolean") else pa.int64() for c in keyed.split(", ")]

    def row_of(key: dict, f: Fragment) -> pa.RecordBatch:
        cells = {**key, **_row(f)}
        return pa.RecordBatch.from_arrays([pa.array([cells[n]], k) for n, k in zip(names, kinds)], names=names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = pair(a, b)
        for batch in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            r = batch.to_pylist()[0]
            f = encode_range(code, r["a0"], r["a1"], r["b0"], r["b1"], r["part"], r["begin"])
            yield row_of({k: r[k] for k in ("key", "doc_id", "nr", "n")}, f)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, held, key = pair(a, b), [], None

        def flush() -> pa.RecordBatch:
            f = reduce(lambda x, y: compose(code, x, y), [_fragment(r) for r in held])
            return row_of({**key, "n": -(-held[0]["n"] // FAN)}, f)

        for batch in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            r = batch.to_pylist()[0]
            now = {"key": r["key"], "doc_id": r["doc_id"], "nr": r["nr"] // FAN}
            if now != key and held:
                yield flush()
                held = []
            key = now
            held.append(r)
        if held:
            yield flush()

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(1, keep_groups)
        for batch in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            r = batch.to_pylist()[0]
            codes = np.frombuffer(r["codes"], "<i8")
            if r["good"]:
                yield blocks.row([r["doc_id"]], np.array([[r["n_a"], r["n_b"], r["n_groups"], len(codes)]]), [r["text"]], codes)
            else:
                yield blocks.row([r["doc_id"]], np.zeros((1, 4), np.int64), [None], EMPTY)

    # the key of a row is made once and stored, so that its ranges find each other
    ranges = written(rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").mapInArrow(cut, RANGE), "ranges")
    parts = written(ranges.repartition("key", "nr").mapInArrow(encode, keyed), "fragments")
    width = parts.agg(F.max("n")).first()[0] or 1
    while width > 1:
        dealt = parts.repartition("key", F.floor(F.col("nr") / FAN)).sortWithinPartitions("key", "nr")
        parts = written(dealt.mapInArrow(join, keyed), "fragments")
        width = -(-width // FAN)
    return parts.mapInArrow(close, BLOCKS)


def align(docs: DataFrame, a: str, b: str, keep_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups) of every row. ``a`` is the file
    of a byte-level vocabulary, ``b`` one of pieces. ``groups`` is the text under the digest, or null if it is not kept."""
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    long_text = F.coalesce(F.octet_length("text") > CHUNK, F.lit(False))
    made = _short(rows.filter(~long_text), a, b, keep_groups).unionByName(_long(rows.filter(long_text), a, b, keep_groups))
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), fresh_name("aligned")
    made.write.bucketBy(buckets, "block").option("path", new_dir(spark, "aligned")).option("compression", "zstd").saveAsTable(name)
    try:
        return written(_counted(spark.table(name), buckets, keep_groups), "alignment")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _counted(blocks: DataFrame, buckets: int, keep_groups: bool) -> DataFrame:
    numbered = blocks.select("block", F.posexplode(F.arrays_zip("codes", "times")).alias("number", "p"))
    numbered = numbered.select("block", "number", F.col("p.codes").alias("code"), F.col("p.times").alias("times"))
    totals = written(numbered.groupBy("code").agg(F.sum("times").alias("total")), "pair-totals")
    b_id = F.col("code").bitwiseAND(F.lit((1 << 32) - 1))
    highest = totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("highest"))
    rated = totals.withColumn("b", b_id).join(highest, "b").select("code", "total", (F.col("total") == F.col("highest")).alias("best"))
    back = numbered.select("block", "number", "code").join(rated, "code").repartition(buckets, "block")
    per_block = back.groupBy("block").agg(F.collect_list(F.struct("number", "total", "best")).alias("pairs"))
    per_block = per_block.select("block", F.col("pairs.number").alias("number"), F.col("pairs.total").alias("total"), F.col("pairs.best").alias("best"))
    joined = blocks.select("block", "doc_ids", "counts", "digests", "groups", "stops", "links").join(per_block, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            ids, digests, groups = (batch.column(i).flatten() for i in (1, 3, 4))
            counts = np.frombuffer(batch.column(2)[0].as_py(), "<i8").reshape(-1, 4)
            stops = np.frombuffer(batch.column(5)[0].as_py(), "<i8")
            links = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column(6)[0].as_py()), "<u4")
            number, total, best = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (7, 8, 9))
            by_number = np.empty(len(number), np.int64)
            by_number[number] = np.arange(len(number))
            which = by_number[links]
            sums = [np.concatenate(([0], np.cumsum(x.astype(np.int64)[which]))) for x in (best, total)]
            sums = [np.diff(s[np.concatenate(([0], stops))]) for s in sums]
            columns = [ids, *[pa.array(counts[:, i].copy()) for i in range(4)], *[pa.array(s) for s in sums], digests]
            yield pa.RecordBatch.from_arrays([*columns, groups if keep_groups else pa.nulls(len(ids), pa.string())], names=NAMES)

    return joined.mapInArrow(run, RESULT)


RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
)
NAMES = [c.split()[0] for c in RESULT.split(", ")]
