"""BPE encoding by forced boundaries, and decoding.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged, so a text
may be cut between them: the fragments are encoded independently and their ids are concatenated.
White space is the commonest such cut, since no token holds any; others lie inside words. Ids of
words are remembered in a bounded cache per worker, which pays because words repeat.

Null texts count as empty and give no ids. A text is never shortened; memory is bounded by the
longest text and the cache. The vocabulary file is a parameter; it has to lie at the same path on
every executor.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusaudit.llm.store import give_back

CACHED_WORDS = 100_000
BYTES_AT_ONCE = 1_500_000
CHARS_AT_ONCE = 1_500_000
PARTS_AT_ONCE = 1000
ROWS_AT_ONCE = 1000  # of ids and decoded texts held beside a batch
ID = np.dtype("<u4")
SIMPLE_TEXT = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
SIMPLE_WORD = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]+")
ASCII_WORD = re.compile(r"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]+")
SIMPLE_BYTES = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F)])


# Kinds of bytes in texts of ASCII and Latin-1 letters: white space, letters, digits, all others.
SPACE, LETTER, DIGIT, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[*range(0x09, 0x0E), 0x20]] = SPACE
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
KINDS[0x30:0x3A] = DIGIT
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it
    is printable in Latin-1, else the next one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


BYTE_ALPHABET = _byte_alphabet()


def is_simple(text: bytes) -> bool:
    """Whether a text holds only ASCII and letters of Latin-1, and no special token."""
    if b"<|" in text:
        return False
    return not text.translate(None, SIMPLE_BYTES) or SIMPLE_TEXT.fullmatch(text.decode("utf-8")) is not None


# The rules of normalisation and splitting that the fast path follows, as the file states them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTING = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def refuse_others(path: str, config: dict) -> None:
    """Raises for files whose rules are not those of the fast path, instead of giving wrong ids."""
    normal, split, model = config["normalizer"] or {}, config["pre_tokenizer"] or {}, config["model"]
    parts = split.get("pretokenizers", [])
    fits = {
        "normalizer": normal.get("normalizers") == NORMALIZERS,
        "pre_tokenizer": len(parts) == 2
        and (parts[0].get("pattern"), parts[0].get("behavior"), parts[0].get("invert")) == ({"Regex": SPLITTING}, "Removed", True)
        and (parts[1].get("type"), parts[1].get("add_prefix_space"), parts[1].get("use_regex")) == ("ByteLevel", False, False),
        "decoder": config["decoder"] is None and config["post_processor"] is None,
        "model": model["type"] == "BPE" and bool(model["end_of_word_suffix"])
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
    }
    other = [name for name, ok in fits.items() if not ok]
    if other:
        raise ValueError(f"{path}: this encoder does not cover its {', '.join(other)}")


class Encoder:
    """Encodes with a vocabulary whose pre-tokenizer drops white space and marks word ends."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        refuse_others(path, config)
        model = config["model"]
        suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        # Fragments at the end of a word carry the suffix, those inside a word do not.
        self.models = [
            Tokenizer(BPE(model["vocab"], merges)),
            Tokenizer(BPE(model["vocab"], merges, end_of_word_suffix=suffix)),
        ]
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.names = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        names = [self.names.get(i, "") for i in range(max(self.names) + 1)]
        self.tokens = [t.encode() for t in names]
        # bytes of a text that each token stands for
        self.widths = np.array([len(t.removesuffix(suffix)) for t in names], np.int64)
        self.joins = joining_pairs(model["vocab"], suffix)
        self.cached, self.recent, self.older = cached, {}, {}

    def fragments(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Non-empty words (in the byte alphabet of the vocabulary) cut at forced boundaries: the fragments,
        the word of each, and whether it ends the word."""
        flat = "".join(words)
        if not flat:
            return [], np.zeros(0, np.int64), np.zeros(0, bool)
        codes = np.frombuffer(flat.encode("utf-16-le"), "<u2")
        ends = np.cumsum([len(w) for w in words])
        cut = np.ones(len(codes), bool)
        cut[:-1] = ~self.joins[codes[:-1], codes[1:]]
        cut[ends - 1] = True
        stops = np.flatnonzero(cut) + 1
        begin = 0
        parts = []
        for stop in stops.tolist():
            parts.append(flat[begin:stop])
            begin = stop
        return parts, np.searchsorted(ends, stops, "left"), np.isin(stops, ends)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokenized words, which are not empty."""
        if not words:
            return []
        parts, word_of, last = self.fragments(words)
        found = []
        for is_end, model in enumerate(self.models):
            at = np.flatnonzero(last == bool(is_end))
            chosen = [parts[i] for i in at.tolist()]
            # many fragments make one pre-tokenized input, so that the library answers with few objects
            runs = [chosen[i : i + PARTS_AT_ONCE] for i in range(0, len(chosen), PARTS_AT_ONCE)]
            for k, e in enumerate(model.encode_batch(runs, is_pretokenized=True, add_special_tokens=False)):
                part_of = at[np.array(e.word_ids, np.int64) + k * PARTS_AT_ONCE]
                found.append((part_of, np.array(e.ids, ID)))
        part_of, ids = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        raw = ids[np.argsort(part_of, kind="stable")].tobytes()
        stops = 4 * np.cumsum(np.bincount(word_of[part_of], minlength=len(words)))
        starts = np.concatenate(([0], stops[:-1]))
        return [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())]

    def _encode_chunk(self, chunk: bytes) -> bytes:
        """The ids of a chunk with characters beyond Latin-1 or special tokens."""
        out = b""
        text = chunk.decode("utf-8")
        for part in self.special_at.split(text) if self.special_at else [text]:
            if part in self.special:
                out += array("I", [self.special[part]]).tobytes()
            elif part:
                normal = self.normalizer.normalize_str(part)
                out += b"".join(self._encode_words([w for w, _ in self.pre_tokenizer.pre_tokenize_str(normal)]))
        return out

    def words(self, text: bytes) -> list:
        """The words of a text, and as they are (bytes) those chunks that need the full rules of
        normalisation and splitting. Texts of ASCII and letters of Latin-1 need lower case and one
        pattern: nothing in them composes."""
        if is_simple(text):
            pattern = ASCII_WORD if text.isascii() else SIMPLE_WORD
            return pattern.findall(text.decode("utf-8").lower())
        out: list = []
        for chunk in text.split():  # at ASCII white space
            part = chunk.decode("utf-8")
            if SIMPLE_TEXT.fullmatch(part) and "<|" not in part:
                out.extend(SIMPLE_WORD.findall(part.lower()))
            else:
                out.append(chunk)
        return out

    def known(self, wanted: list) -> list[bytes]:
        """The ids (little-endian, 32 bits each) of distinct words or chunks."""
        if len(self.recent) > self.cached:
            self.older, self.recent = self.recent, {}
        found = list(map(self.recent.get, wanted))
        missing = [i for i, f in enumerate(found) if f is None]
        if self.older:
            for i in missing:
                found[i] = self.older.get(wanted[i])
            self.recent.update((wanted[i], found[i]) for i in missing if found[i] is not None)
            missing = [i for i in missing if found[i] is None]
        words = [i for i in missing if isinstance(wanted[i], str)]
        mapped = [w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_ALPHABET) for w in map(wanted.__getitem__, words)]
        for i, ids in zip(words, self._encode_words(mapped)):
            found[i] = ids
        if len(words) < len(missing):
            for i in missing:
                if found[i] is None:
                    found[i] = self._encode_chunk(wanted[i])
        self.recent.update((wanted[i], found[i]) for i in missing)
        return found

    def forget(self) -> None:
        """Gives the memory of the cache back; a worker outlives the stage that filled it."""
        self.recent, self.older = {}, {}
        give_back()

    def encode(self, texts: list[bytes], at_once: int = BYTES_AT_ONCE) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers. ``at_once`` bytes of texts share a look-up of
        their distinct words."""
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and is_simple(t)]
        seen = set(plain)
        other = [i for i, t in enumerate(texts) if t and i not in seen]
        for at, encode in ((plain, self._encode_plain), (other, self._encode_other)):
            begin = 0
            while begin < len(at):
                stop, size = begin, 0
                while stop < len(at) and size < at_once:
                    size += len(texts[at[stop]])
                    stop += 1
                for i, ids in zip(at[begin:stop], encode([texts[i] for i in at[begin:stop]])):
                    out[i] = ids
                begin = stop
        return out

    def _encode_plain(self, texts: list[bytes]) -> list[bytes]:
        """Texts of ASCII and letters of Latin-1, without special tokens. Borders of words are found on
        the bytes of all texts at once, and only distinct words are looked up."""
        data, offsets, first = split_plain(texts)
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        found = self.known(words.dictionary.cast(pa.string()).to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(found), ID)
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = words.indices.to_numpy()
        own = counts[which]
        stops = np.cumsum(own)
        del words
        total = int(stops[-1]) if len(stops) else 0
        at = np.repeat(((np.cumsum(counts) - counts)[which] - (stops - own)).astype(np.int32), own)
        at += np.arange(total, dtype=np.int32)
        ids = flat[at].tobytes()
        borders = 4 * np.concatenate(([0], stops))[first]
        return [ids[a:b] for a, b in zip(borders.tolist(), borders[1:].tolist())]

    def _encode_other(self, texts: list[bytes]) -> list[bytes]:
        parts = [self.words(t) for t in texts]
        wanted = list(set().union(*parts))
        known = dict(zip(wanted, self.known(wanted)))
        return [b"".join([known[w] for w in words]) for words in parts]

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        """The tokens joined by a space, as the file (which names no decoder) asks for. Ids that
        the vocabulary lacks give nothing."""
        tokens, n = self.tokens, len(self.tokens)
        values = np.frombuffer(ids, ID).tolist() if isinstance(ids, bytes) else np.asarray(ids).tolist()
        return b" ".join([tokens[i] for i in values if i < n and tokens[i]])


def split_plain(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, where each word begins there, the first word of each text): lower-cased
    runs of letters, single digits, the seven contractions, and runs of other characters."""
    raw = np.frombuffer(b" ".join(texts) + b"   ", np.uint8)
    low = LOWERED[raw]
    # A letter of Latin-1 is two bytes, of which the second tells the case.
    capital = np.flatnonzero(raw[:-1] == 0xC3) + 1
    low[capital[raw[capital] <= 0x9E]] += 32
    kind = KINDS[raw]
    start = kind != SPACE
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    quote = np.flatnonzero(start & (low == ord("'")))
    one, two = low[quote + 1], low[quote + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for at, size in ((quote[short], 2), (quote[pairs], 3)):
        start[at + 1] = False
        start[at + size] = kind[at + size] != SPACE
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(np.flatnonzero(start), np.concatenate(([0], ends)))
    solid = kind != SPACE
    data = low[solid]
    return data, np.append(np.flatnonzero(start[solid]), len(data)).astype(np.int32), first


def joining_pairs(vocab: dict[str, int], suffix: str) -> np.ndarray:
    """joins[a, b]: some token holds the characters a and b (of the byte alphabet) side by side."""
    joins = np.zeros((512, 512), bool)
    for token in vocab:
        body = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
        for a, b in zip(body, body[1:]):
            if ord(a) < 512 and ord(b) < 512:
                joins[ord(a), ord(b)] = True
    return joins


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path)


def as_bytes(column: pa.Array) -> list[bytes]:
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """The columns of ``docs`` with ``ids``, an array of the text's token ids, and ``decoded``,
    what these ids decode to. Columns of these names in ``docs`` are replaced."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("ids", "decoded")]
    text_at = [f.name for f in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            ids = code.encode(as_bytes(batch.column(text_at)))
            stops = np.cumsum([0] + [len(i) // 4 for i in ids]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), ID).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(stops), values)
            decoded = pa.array([code.decode(i).decode("utf-8", "replace") for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, decoded], names=[*batch.schema.names, "ids", "decoded"])
        code.forget()

    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select(*[docs[f"`{f.name}`"] for f in kept]).mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode_texts`` makes,
    taken where it is made so that neither ids nor decoded texts leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            ids = code.encode(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(code.decode(i)).hexdigest() for i in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, schema)
