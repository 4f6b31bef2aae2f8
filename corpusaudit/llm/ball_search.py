"""Ranked lexical search: exact inner products found through sparse ball trees.

Texts and queries are vectors over terms. A text's value for a term follows from how often it holds
the term and from its length, a query's weight from how rare the term is; all are integers, and the
score is the sum of their products. Vectors keep the terms of the queries only, since others add
nothing to any score and would widen the balls.

``build`` packs each run of at most ``BLOCK_ROWS`` vectors into one row, with a binary tree over it:
every node has a centroid and a radius around all of its texts. For a text x below a node,

    <q, x> = <q, c> + <q, x - c>  <=  <q, c> + |q on the terms of c| * radius,

as x and c hold no term outside the centroid's. Both sides are scaled by the root of the weights, which
leaves products as they are and evens out the two norms. Radii and bounds are rounded up by more than
the arithmetic can err, so a subtree is only left out if none of its texts can reach the k-th score
found; ties always can. ``search`` takes the nodes of a block best first and scores leaves in integers.
A task carries its k best on from block to block and returns no more than k rows per query.

Queries are taken in blocks of ``ITEMS`` rows, or fewer of many terms, each against all texts. A null or empty text
and one without terms is no document. Rows that repeat an id are documents of their own; equal scores
are ordered by id, a missing id last. Queries that repeat an id are ranked on their own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusaudit.llm.bpe import as_bytes
from corpusaudit.llm.store import written

ITEMS = 256
TERMS = 20_000  # of all queries in a block, unless one alone has more
BLOCK_ROWS = 4096
BLOCK_VALUES = 2_000_000
LEAF_ROWS = 32
SLICE = 1 << 20  # bytes split into terms at once
COLUMNS = 4096  # terms multiplied at once
SAFE = 1e-9  # relative rounding up of radii and bounds; sums of doubles err by less than 1e-11
FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order: runs of ASCII letters and digits and of all other characters
    beyond ASCII, A-Z in lower case."""
    folded = text.translate(FOLDED)
    begin = 0
    while begin < len(folded):
        stop = folded.find(b" ", begin + SLICE)
        stop = len(folded) if stop < 0 else stop
        yield folded[begin:stop].split()
        begin = stop


class Queries:
    """A block of queries: their ids, and the numbers of each one's distinct terms."""

    def __init__(self, rows: list, number: dict[bytes, int] | None = None):
        self.ids = [r[0] for r in rows]
        self.number: dict[bytes, int] = {}
        self.terms = []
        for _, text in rows:
            own = dict.fromkeys(t for part in terms((text or "").encode()) for t in part)
            self.terms.append(np.array([self.number.setdefault(t, len(self.number)) for t in own], np.int64))


def blocks_of(items: DataFrame, item: str, text: str) -> Iterator[Queries]:
    rows = map(tuple, items.select(item, text).toLocalIterator())
    while batch := list(islice(rows, ITEMS)):
        while batch:
            size, seen = 0, set()
            for _, words in batch:
                seen.update(t for part in terms((words or "").encode()) for t in part)
                if size and len(seen) > TERMS:
                    break
                size += 1
            yield Queries(batch[:size])
            batch = batch[size:]


def vectors(docs: DataFrame, queries: Queries) -> DataFrame:
    """(doc_id, n, terms, times): the length in terms of every document, which of the queries' terms
    it holds, and how often."""
    number = queries.number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            lengths, held, times = [], [], []
            for text in as_bytes(batch.column(1)):
                n, found = 0, []
                for part in terms(text):
                    n += len(part)
                    found.append(np.array([i for i in map(number.get, part) if i is not None], np.int32))
                own, counts = np.unique(np.concatenate(found or [np.zeros(0, np.int32)]), return_counts=True)
                lengths.append(n)
                held.append(own)
                times.append(counts.astype(np.int32))
            at = np.flatnonzero(np.array(lengths, np.int64))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(held[i]) for i in at]))).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *[x[i] for i in at]])))
                for x in (held, times)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array([lengths[i] for i in at], pa.int64()), *lists],
                names=["doc_id", "n", "terms", "times"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<int>")


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def values(times: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A text's value for a term that it holds ``times`` times; ``length`` is the text's."""
    distinct, which = np.unique(length, return_inverse=True)
    m = np.array([100 - 50 + 50 * int(n) * n_docs // n_terms for n in distinct], np.int64)[which]
    times = times.astype(np.int64)
    return 1_000_000_000 * times // (1000 * times + 20 * m)


class Tree:
    """A ball tree over sparse rows. Rows are stored in the order of the leaves; node i covers rows
    [first[i], last[i]) and its children are left[i] and left[i] + 1, or it is a leaf if that is 0."""

    PARTS = (
        ("starts", "<i8"), ("terms", "<i4"), ("values", "<i8"), ("first", "<i8"), ("last", "<i8"), ("left", "<i8"),
        ("radius", "<f8"), ("c_starts", "<i8"), ("c_terms", "<i4"), ("c_values", "<f8"),
    )

    def __init__(self, parts: dict[str, np.ndarray]):
        self.__dict__.update(parts)

    @classmethod
    def over(cls, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, weight: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree over rows in compressed form, and the order that it puts them in."""
        n, width = len(starts) - 1, len(weight)
        row = np.repeat(np.arange(n), np.diff(starts))
        scaled = values * np.sqrt(weight[terms].astype(float))
        norm = np.bincount(row, scaled * scaled, n)
        order = np.arange(n)
        first, last, left, radius, centres = [0], [n], [0], [], []

        def entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sizes = starts[rows + 1] - starts[rows]
            at = np.repeat(starts[rows] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            return at, np.repeat(np.arange(len(rows)), sizes)

        node = 0
        while node < len(first):  # breadth first, so children lie beside each other
            rows = order[first[node] : last[node]]
            at, own = entries(rows)
            t, v = terms[at], scaled[at]
            held = np.unique(t)
            column = np.searchsorted(held, t)
            centre = np.bincount(column, v, len(held)) / max(len(rows), 1)
            apart = lambda c: norm[rows] - 2 * np.bincount(own, v * c[column], len(rows)) + float(c @ c)  # noqa: B023, E731
            far = apart(centre)
            size = norm[rows].max(initial=0) + float(centre @ centre)
            radius.append(math.sqrt(max(far.max(initial=0), 0) + SAFE * size) * (1 + SAFE))
            centres.append((held, centre))
            if len(rows) > LEAF_ROWS:
                ends = []
                for pick in (int(far.argmax()), None):
                    pick = int(apart(ends[0]).argmax()) if pick is None else pick
                    mine = own == pick
                    ends.append(np.bincount(column[mine], v[mine], len(held)))
                along = np.bincount(own, v * (ends[0] - ends[1])[column], len(rows))
                order[first[node] : last[node]] = rows[np.argsort(along, kind="stable")]
                middle = (first[node] + last[node]) // 2
                left[node] = len(first)
                first += [first[node], middle]
                last += [middle, last[node]]
                left += [0, 0]
            node += 1
        at, own = entries(order)
        parts = {
            "starts": np.concatenate(([0], np.cumsum(np.bincount(own, minlength=n)))), "terms": terms[at], "values": values[at],
            "first": first, "last": last, "left": left, "radius": radius,
            "c_starts": np.cumsum([0] + [len(h) for h, _ in centres]),
            "c_terms": np.concatenate([h for h, _ in centres]), "c_values": np.concatenate([c for _, c in centres]),
        }
        return cls({k: np.asarray(parts[k]).astype(kind) for k, kind in cls.PARTS}), order

    def bounds(self, queries: Queries, weight: np.ndarray) -> np.ndarray:
        """For each node and query a number that no score below the node exceeds."""
        n, m = len(self.first), len(queries.terms)
        node = np.repeat(np.arange(n), np.diff(self.c_starts))
        q_row = np.repeat(np.arange(m), [len(t) for t in queries.terms])
        q_term = np.concatenate([np.zeros(0, np.int64), *queries.terms])
        centre, norm = np.zeros((n, m)), np.zeros((n, m))
        for begin in range(0, len(weight), COLUMNS):
            mine = (self.c_terms >= begin) & (self.c_terms < begin + COLUMNS)
            theirs = (q_term >= begin) & (q_term < begin + COLUMNS)
            c, held, q = np.zeros((n, COLUMNS)), np.zeros((n, COLUMNS)), np.zeros((COLUMNS, m))
            c[node[mine], self.c_terms[mine] - begin] = self.c_values[mine]
            held[node[mine], self.c_terms[mine] - begin] = 1
            q[q_term[theirs] - begin, q_row[theirs]] = np.sqrt(weight[q_term[theirs]])
            centre += c @ q
            norm += held @ (q * q)
        raw = centre + np.sqrt(norm) * self.radius[:, None]
        return raw * (1 + SAFE) + 1

    def best(self, bound: np.ndarray, weight_of: np.ndarray, k: int, found: tuple[np.ndarray, np.ndarray], name: int):
        """``found`` (scores, names of rows) with the rows of this tree that may belong to the k best.
        Rows of this tree are named ``name`` + place."""
        scores, names = found
        least = np.partition(scores, -k)[-k] if len(scores) >= k else 1
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= least:
            limit, node = heapq.heappop(heap)
            if self.left[node]:
                for child in (int(self.left[node]), int(self.left[node]) + 1):
                    heapq.heappush(heap, (-min(bound[child], -limit), child))
                continue
            a, b = int(self.first[node]), int(self.last[node])
            s, e = self.starts[a], self.starts[b]
            parts = np.concatenate(([0], np.cumsum(weight_of[self.terms[s:e]] * self.values[s:e])))
            own = np.diff(parts[self.starts[a : b + 1] - s])
            at = np.flatnonzero(own >= least)
            if len(at):
                scores, names = np.concatenate((scores, own[at])), np.concatenate((names, name + a + at))
                if len(scores) >= k:
                    least = max(least, np.partition(scores, -k)[-k])
                    keep = scores >= least
                    scores, names = scores[keep], names[keep]
        return scores, names


def build(rows: DataFrame, weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """The stored index: a row per block of documents, with its tree."""
    schema = "doc_ids array<long>, " + ", ".join(f"{k} binary" for k, _ in Tree.PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            lists = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            value = values(lists[1], np.repeat(batch.column(1).to_numpy(), sizes), n_docs, n_terms)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            begin = 0
            while begin < len(sizes):
                stop = int(np.searchsorted(starts, starts[begin] + BLOCK_VALUES, "right")) - 1
                stop = min(max(stop, begin + 1), begin + BLOCK_ROWS, len(sizes))
                s, e = starts[begin], starts[stop]
                tree, order = Tree.over(starts[begin : stop + 1] - s, lists[0][s:e], value[s:e], weight)
                ids = batch.column(0).slice(begin, stop - begin).take(pa.array(order)).to_pylist()
                cells = [pa.array([ids], pa.list_(pa.int64()))]
                cells += [pa.array([getattr(tree, k).tobytes()], pa.binary()) for k, _ in Tree.PARTS]
                yield pa.RecordBatch.from_arrays(cells, names=["doc_ids", *[k for k, _ in Tree.PARTS]])
                begin = stop

    return written(rows.mapInArrow(run, schema), "ball-trees")


def _ranked(index: DataFrame, queries: Queries, weight: np.ndarray, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.terms]
        ids: list = []  # of the rows that are among the k best of some query
        weight_of = np.zeros(len(weight), np.int64)
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                tree = Tree({p: np.frombuffer(row[p], kind) for p, kind in Tree.PARTS})
                bounds = tree.bounds(queries, weight)
                mine = row["doc_ids"]
                for q, own in enumerate(queries.terms):
                    if len(own) == 0:
                        continue
                    weight_of[own] = weight[own]
                    scores, names = tree.best(bounds[:, q], weight_of, k, found[q], len(ids))
                    weight_of[own] = 0
                    if len(scores) > k:  # more than k where scores are equal: by id, a missing one last
                        all_ids = [ids[i] if i < len(ids) else mine[i - len(ids)] for i in names.tolist()]
                        keys = sorted(range(len(scores)), key=lambda i: (-scores[i], all_ids[i] is None, all_ids[i] or 0))[:k]
                        scores, names = scores[keys], names[keys]
                    found[q] = scores, names
                ids += mine
                used = np.unique(np.concatenate([n for _, n in found])) if found else np.zeros(0, np.int64)
                ids = [ids[i] for i in used.tolist()]
                found = [(s, np.searchsorted(used, n)) for s, n in found]
        for q, (scores, names) in enumerate(found):
            if len(scores):
                n = len(scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * n, pa.int32()), pa.array([ids[i] for i in names.tolist()], pa.int64()), pa.array(scores)],
                    names=["query", "doc_id", "score"],
                )

    return index.mapInArrow(run, "query int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0 for each row
    of ``items``, best first; all of them if there are fewer."""
    spark = docs.sparkSession
    kind = items.schema[item].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    parts = []
    for queries in blocks_of(items, item, text):
        rows = written(vectors(docs, queries), "term-vectors")
        n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
        if not n_docs or not queries.number:
            continue
        df = np.zeros(len(queries.number), np.int64)
        for t, n in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[t] = n  # a number per term of the queries
        weight = weights(df, n_docs)
        found = _ranked(build(rows, weight, n_docs, n_terms), queries, weight, k)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = found.select("query", place.alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"query int, item_id {kind}")  # at most ITEMS rows
        parts.append(written(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
