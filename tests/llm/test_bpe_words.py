"""Word borders found on bytes against the pattern that defines them."""

import random

import numpy as np
import pytest

from corpusaudit.llm import bpe
from corpusaudit.llm.queries import BYTE_VOCABULARY, VOCABULARY


def test_split_equals_the_pattern():
    rng = random.Random(4)
    letters = "abcXYZstmdrevl'''  \t\n09.,!_-" + "ÀÉßéÿØø"
    for _ in range(300):
        texts = ["".join(rng.choices(letters, k=rng.randrange(1, 40))).encode() for _ in range(rng.randrange(1, 8))]
        data, offsets, first = bpe.split_plain(texts)
        words = [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
        want = [bpe.SIMPLE_WORD.findall(t.decode().lower()) for t in texts]
        assert words == [w for t in want for w in t]
        assert first.tolist() == np.cumsum([0, *map(len, want)]).tolist()


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="does not cover its normalizer, pre_tokenizer, decoder, model"):
        bpe.Encoder(BYTE_VOCABULARY)


def test_encoding_is_the_same_in_any_grouping(monkeypatch):
    code = bpe.Encoder(VOCABULARY, cached=3)
    texts = [b"", b"It's a test, isn't it? 12", " ÀÉ x 日本 <|endoftext|>".encode(), b"'s's 'll'", b"   ", b"word " * 50]
    whole = code.encode(texts)
    monkeypatch.setattr(bpe, "BYTES_AT_ONCE", 5)
    assert code.encode(texts) == whole == [bpe.Encoder(VOCABULARY).encode([t])[0] for t in texts]
