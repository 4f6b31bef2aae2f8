"""Token counts of sections of a text, from one encoding of the whole text.

Every token has a span of characters in the text. Token spans are joined with the section spans by
interval: a token counts for the section that holds its first character, also where it runs on into
the next one. Sections may overlap or leave gaps; a token outside all sections counts for none.

Null and empty texts have no tokens; their sections, if any, count 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusaudit.llm.bpe import CHARS_AT_ONCE, ID, as_bytes, encoder, is_simple

CACHED_CHUNKS = 100_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True  # where bytes.split() splits


def lines(text: str) -> list[tuple[int, int]]:
    """The lines of a text as sections [start, end), each with its newline."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line) + 1))
        at += len(line) + 1
    return out


class Offsets:
    """First characters of tokens. In plain texts the tokens follow each other over all bytes that
    are not white space, so their widths tell where they start; chunks of other texts are asked of
    the library, which reports offsets, and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.code = encoder(path)
        self.known: dict[bytes, np.ndarray] = {}

    def learn(self, wanted: set[bytes]) -> None:
        if len(self.known) > CACHED_CHUNKS:
            self.known = {}
        new = list(wanted.difference(self.known))
        found = self.library.encode_batch([c.decode("utf-8") for c in new], add_special_tokens=False)
        self.known.update((c, np.array([s for s, _ in f.offsets], np.int64)) for c, f in zip(new, found))

    def from_library(self, text: bytes) -> np.ndarray:
        chunks = text.split()
        if not chunks:
            return np.zeros(0, np.int64)
        self.learn(set(chunks))
        raw = np.frombuffer(text, np.uint8)
        space = SPACE[raw]
        first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        char_at = np.cumsum((raw & 0xC0) != 0x80) - 1
        parts = [self.known[c] for c in chunks]
        sizes = [len(p) for p in parts]
        return np.concatenate(parts) + np.repeat(char_at[first], sizes)

    def starts(self, texts: list[bytes]) -> list[np.ndarray]:
        plain = [i for i, t in enumerate(texts) if is_simple(t)]
        out = dict.fromkeys(range(len(texts)))
        for i, ids in zip(plain, self.code.encode([texts[i] for i in plain])):
            raw = np.frombuffer(texts[i], np.uint8)
            at = np.flatnonzero(~SPACE[raw])
            ends = np.cumsum(self.code.widths[np.frombuffer(ids, ID)])
            if (ends[-1] if len(ends) else 0) != len(at):
                continue  # some bytes have no token
            at = at[np.concatenate(([0], ends[:-1]))] if len(ends) else at
            out[i] = at if texts[i].isascii() else (np.cumsum((raw & 0xC0) != 0x80) - 1)[at]
        return [self.from_library(t) if out[i] is None else out[i] for i, t in enumerate(texts)]


@lru_cache(maxsize=2)
def offsets(path: str) -> Offsets:
    return Offsets(path)


def section_counts(
    docs: DataFrame, path: str, sections: Callable[[str], Sequence[tuple[int, int]]] = lines
) -> DataFrame:
    """(doc_id, section, start, end, n_tokens), a row for each section of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = offsets(path)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            begin = 0
            while begin < len(texts):
                stop, size = begin, 0
                while stop < len(texts) and size < CHARS_AT_ONCE:
                    size += len(texts[stop])
                    stop += 1
                spans = [np.array(sections(t.decode("utf-8")), np.int64).reshape(-1, 2) for t in texts[begin:stop]]
                counts = []
                for span, at in zip(spans, code.starts(texts[begin:stop])):
                    at = np.sort(at)
                    counts.append(np.searchsorted(at, span[:, 1]) - np.searchsorted(at, span[:, 0]))
                sizes = np.array([len(s) for s in spans])
                own = np.repeat(np.arange(begin, stop), sizes)
                section = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                flat = np.concatenate(spans)
                columns = [batch.column(0).take(pa.array(own))]
                columns += [pa.array(c.astype(np.int64)) for c in (section, flat[:, 0], flat[:, 1], np.concatenate(counts))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "section", "start", "end", "n_tokens"])
                begin = stop
        code.code.forget()

    schema = "doc_id long, section long, start long, end long, n_tokens long"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, schema)
