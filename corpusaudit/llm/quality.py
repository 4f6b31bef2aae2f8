"""Quality classifier by compression.

Two zstandard dictionaries are built, from windows of good and of bad labelled text. A text is
compressed window by window with either; the difference of the sizes over their sum tells which kind
it resembles. A logistic calibration of that difference, of its extremes over windows and of how
well the windows compress by themselves gives a score in [0, 1].

The model is fitted on a bounded sample: ``SAMPLE`` labelled documents per class, by hash of the id,
half of them for the dictionaries and half for the calibration, and ``WINDOWS`` windows per class
taken by hash. Every text is scored whole. Null and empty texts get the score of no evidence. Labels
that are null, or whose document is missing, are not used; without labels of both kinds every score
is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.llm.bpe import as_bytes
from corpusaudit.llm.store import give_back

FOLDS = 5
SAMPLE = 3000  # labelled documents per class
WINDOWS = 4000  # windows per class for the dictionaries
WINDOW = 1024  # bytes compressed at a time
DICTIONARY = 262_144
LEVEL = 3
CUT = 0.3
SEED = 7


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _windows(text: bytes) -> list[bytes]:
    return [text[i : i + WINDOW] for i in range(0, len(text), WINDOW)]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        def with_dictionary(data: bytes):
            d = z.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = with_dictionary(good), with_dictionary(bad)
        self.plain = z.ZstdCompressor(level=LEVEL, write_content_size=False)

    def features(self, text: bytes) -> list[float]:
        """[1, difference, its least and largest over windows, ratio, its least, short text]."""
        parts = _windows(text)
        if not parts:
            return [1.0, 0.0, 0.0, 0.0, 0.5, 0.5, 1.0]
        sizes = np.array([[len(c.compress(p)) for c in (self.good, self.bad, self.plain)] for p in parts], float)
        length = np.array([len(p) for p in parts], float)
        difference = (sizes[:, 1] - sizes[:, 0]) / (sizes[:, 0] + sizes[:, 1])
        ratio = sizes[:, 2] / length
        total = sizes.sum(0)
        full = length >= min(WINDOW, len(text)) / 2  # a short last window says little
        return [
            1.0, (total[1] - total[0]) / (total[0] + total[1]), difference[full].min(), difference[full].max(),
            total[2] / length.sum(), ratio[full].min(), 1 / (1 + len(text) / 500),
        ]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Features and the squares of the ratios, on a common scale."""
    scale = np.array([1.0, 10.0, 10.0, 10.0, 4.0, 4.0, 2.0])
    x = x * scale
    return np.column_stack([x, x[:, 4] ** 2, x[:, 5] ** 2])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled rows outside the held-out fold. Only ids and labels are sorted; the texts of
    the sample are read by a broadcast of its ids, whose number ``SAMPLE`` bounds. Of the texts of a repeated id
    the first in order counts, and an id with both labels counts for both."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].alias("label"))
    known = known.filter("doc_id is not null and label in (0, 1)").filter(remainder(F.col("doc_id")) != 0)
    order = F.xxhash64(F.lit(SEED), "doc_id")
    chosen = [known.filter(F.col("label") == c).orderBy(order, "doc_id").limit(SAMPLE) for c in (0, 1)]
    sample = chosen[0].unionByName(chosen[1]).withColumn("half", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(2)))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # one text of each id, so that repeated ids do not widen what is gathered
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label", "half").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found = [
                (label, xxhash.xxh3_64_intdigest(w, seed=i) >> 1, w)
                for label, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)))
                for i, w in enumerate(_windows(text))
            ]
            kinds = (pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=["label", "rank", "window"])

    pieces = rows.filter("half = 0").select(F.col("label").cast("int"), "text").mapInArrow(cut, "label int, rank long, window binary")
    held: list[list[bytes]] = []
    for c in (0, 1):
        top = pieces.filter(F.col("label") == c).orderBy("rank").limit(WINDOWS).collect()
        held.append([bytes(r["window"]) for r in top])
    bad, good = (_dictionary(h) for h in held)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / (sum(counts.values()) or 1) if counts else 0.5
    prior = float(np.clip(share, 1e-3, 1 - 1e-3))
    flat = (float(np.log(prior / (1 - prior))),) + (0.0,) * 8
    if not held[0] or not held[1]:
        return Model(good, bad, flat)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Compressors(good, bad)
        for batch in batches:
            values = [by.features(t) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], names=["label", "x"])

    fitted = rows.filter("half = 1").select(F.col("label").cast("int"), "text").mapInArrow(measure, "label int, x array<double>").collect()
    if len({r["label"] for r in fitted}) < 2:
        return Model(good, bad, flat)
    x, y = np.array([r["x"] for r in fitted]), np.array([r["label"] for r in fitted], float)
    weights = _logistic(_scaled(x), y)
    # the sample holds both classes alike; the intercept moves to their share among the labels
    weights[0] += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    return Model(good, bad, tuple(weights.tolist()))


def _dictionary(windows: list[bytes]) -> bytes:
    import zstandard as z

    try:
        return z.train_dictionary(DICTIONARY, windows).as_bytes()
    except z.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(windows)[-DICTIONARY:] or b" " * 8


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` and ``score``, which replaces a column of that name."""
    kept = [f for f in docs.schema.fields if f.name.lower() != "score"]
    text_at = [f.name for f in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, weights = Compressors(model.good, model.bad), np.array(model.weights)
        for batch in batches:
            x = np.array([by.features(t) for t in as_bytes(batch.column(text_at))]).reshape(-1, 7)
            p = 1 / (1 + np.exp(-np.clip(_scaled(x) @ weights, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "score"])
        give_back()

    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])
    return docs.select(*[docs[f"`{f.name}`"] for f in kept]).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the classifier does not reject, in the columns of ``docs``."""
    kept = [c for c in docs.columns if c.lower() != "score"]
    good = score(docs.select(*[docs[f"`{c}`"] for c in kept]), model).filter(F.col("score") >= CUT)
    if len(kept) == len(docs.columns):
        return good.select(*[f"`{c}`" for c in kept])
    # a column of the caller is called like the score: keep it aside
    aside = docs.withColumn("text_", docs["text"]).select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    return score(aside, model).filter(F.col("score") >= CUT).select("row.*")
