"""The alignment of two tokenizers against a plain loop over tokens, and the laws of its fragments."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpusaudit.llm import alignment
from corpusaudit.llm.bpe import BYTE_ALPHABET
from corpusaudit.llm.queries import BYTE_VOCABULARY, PIECE_VOCABULARY


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE_VOCABULARY)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PIECE_VOCABULARY)


def tokens_of(libraries, text):
    a, b = libraries
    byte_of = {c: i for i, c in BYTE_ALPHABET.items()}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], []
    return list(zip(ids_a, np.cumsum([len(x) for x in bytes_a]).tolist())), list(zip(ids_b, np.cumsum([len(x) for x in bytes_b]).tolist()))


def aligned(a, b):
    """(groups, links) by a plain walk over both sides."""
    groups, links, i, j, held = [], [], 0, 0, ([], [])
    while i < len(a) and j < len(b):
        links.append((a[i][0], b[j][0]))
        end = min(a[i][1], b[j][1])
        both = a[i][1] == b[j][1]
        if a[i][1] == end:
            held[0].append(a[i][0])
            i += 1
        if b[j][1] == end:
            held[1].append(b[j][0])
            j += 1
        if both:
            groups.append(held)
            held = ([], [])
    return groups, links


def rendered(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def brute(libraries, rows):
    made = [(i, *tokens_of(libraries, t or "")) for i, t in rows]
    made = [(i, a, b, *aligned(a, b)) for i, a, b in made]
    count = collections.Counter(x for *_, links in made for x in links)
    highest = collections.Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for i, a, b, groups, links in made:
        text = rendered(groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), digest, text))
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.collect())


LONG = "Words and  more   words,\tlines\nand 日本語 text's 😀 " * 40 + "x" * 700 + " " * 50 + "end of it "
ODD = [
    (1, "Hello world, it's   a test"), (1, "Hello world, it's   a test"), (1, "another"), (2, None), (3, ""), (None, "no id"), (None, None), (4, " "),
    (5, "▁under ▁"), (6, "<s> <unk> <|endoftext|> </s><0x41>"), (7, "naïve café — “quoted” 😀‍日本 \u0085 x"), (8, LONG), (9, LONG * 9),
    (9, LONG * 9), (10, "a" * 3000), (11, ("ab  cd\n" * 300)), (12, "x▁y " + LONG), (13, " \n\t  "), (14, "\x00\x1c\x7f control"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 3, "b", [1], "g") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, nr int, block string, codes array<int>, groups string")


@pytest.mark.parametrize("chunk", [100, 1000, 1 << 16])
def test_alignment_equals_brute_force(odd, libraries, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "BLOCK", 4000)
    assert found(alignment.align(odd.repartition(3), BYTE_VOCABULARY, PIECE_VOCABULARY, keep_groups=True)) == brute(libraries, ODD)


def test_alignment_of_nothing(odd):
    assert alignment.align(odd.limit(0), BYTE_VOCABULARY, PIECE_VOCABULARY).count() == 0


def test_alignment_of_documents(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(alignment.align(docs, BYTE_VOCABULARY, PIECE_VOCABULARY, keep_groups=True)) == brute(libraries, rows)


def test_quick_encoder_equals_the_library(libraries):
    code = alignment.ByteTokens(BYTE_VOCABULARY)
    assert code.quick is not None
    settled = [chr(c) for c in range(0x250)]
    rng = random.Random(2)
    texts = [f" {x}{c}{x} {c} {c}{c}1{c}\n{c}'s" for c in settled for x in ("a", "1", ".")]
    texts += ["".join(rng.choices(settled + list("   \n\t'sabe"), k=60)) for _ in range(3000)]
    want = [e.ids for e in libraries[0].encode_batch(texts, add_special_tokens=False)]
    assert code.encode(texts) == want
    assert code.encode([" 日本 ǅ ɐ ͸ ꟊ"]) == [libraries[0].encode(" 日本 ǅ ɐ ͸ ꟊ", add_special_tokens=False).ids]


def parts_of(draws, size):
    """Tokens of random lengths over ``size`` bytes."""
    ends, at = [], 0
    for d in draws:
        at += d
        if at >= size:
            break
        ends.append(at)
    return ends + [size]


class Fake:
    """Stands for a pair of vocabularies: ids are small numbers."""

    n_a = n_b = 10
    written = [b"%d," % i for i in range(10)] + [b"%d|" % i for i in range(10)] + [b"%d," % i for i in range(10)] + [b"%d;" % i for i in range(10)]
    groups = alignment.Pair.groups
    text = alignment.Pair.text


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(1, 9), max_size=60), st.lists(st.integers(1, 9), max_size=60), st.lists(st.integers(0, 60), max_size=5), st.integers(0, 10**6))
def test_fragments_form_a_monoid(size, draws_a, draws_b, at, seed):
    code, rng = Fake(), random.Random(seed)
    sides = [[(rng.randrange(10), e) for e in parts_of(d, size)] for d in (draws_a, draws_b)]
    # ranges own the tokens that begin in them, so their sides need not begin together
    at = [0, *sorted(at), size + 1]
    fragments = []
    for lo, hi in zip(at, at[1:]):
        mine, starts = [], []
        for side in sides:
            begins = [0, *[e for _, e in side[:-1]]]
            own = [t for t, s in zip(side, begins) if lo <= s < hi]
            starts.append(min([s for s in begins if s >= lo], default=size))
            mine += [np.array([i for i, _ in own], np.int64), np.array([e for _, e in own], np.int64)]
        fragments.append(alignment.fragment(code, *starts, *mine))

    def fold(parts):
        if len(parts) == 1:
            return parts[0]
        cut = rng.randrange(1, len(parts))
        return alignment.compose(code, fold(parts[:cut]), fold(parts[cut:]))

    groups, links = aligned(*sides)
    for _ in range(3):
        whole = fold(fragments)
        assert whole.text[:-1].decode() == rendered(groups) and whole.n_groups == len(groups)
        assert [(c >> 32, c & 0xFFFFFFFF) for c in whole.codes.tolist()] == links
        assert len(whole.head_a) == len(whole.tail_a) == len(whole.head_b) == len(whole.tail_b) == 0
        assert (whole.first, whole.last, whole.n_a, whole.n_b) == (0, size, len(sides[0]), len(sides[1]))


def test_libraries_return_the_ids_of_few_texts_at_once(monkeypatch):
    """Before, lists of a whole block's ids, and blocks of 6 MB, stood beside its arrays."""
    code, sizes = alignment.pair(BYTE_VOCABULARY, PIECE_VOCABULARY), []
    texts = [f" text {i} café".encode() for i in range(3 * alignment.TEXTS_AT_ONCE + 5)]
    for side in (0, 1):
        kind = type(code.sides[side])
        monkeypatch.setattr(kind, "encode", lambda self, t, encode=kind.encode: sizes.append(len(t)) or encode(self, t))
        ids, same = code.encode(side, texts)
        assert all(same) and [b"".join(code.sides[side].bytes[i] for i in x) for x in ids] == texts
    assert max(sizes) <= alignment.TEXTS_AT_ONCE and alignment.BLOCK <= 3_000_000
