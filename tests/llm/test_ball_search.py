"""Ranked lexical search against a brute-force ranking in integers, and its bounds against scores."""

import collections
import math
import random
import re

import numpy as np
import pytest

from corpusaudit.llm import ball_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=50):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "ñandú", "日本", "A1"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(1000, 1120)]  # ties beyond k
    rows += [(7, rows[7][1]), (7, "another text of w1 w2"), (None, rows[7][1]), (None, None), (2000, None), (2001, ""), (2002, " .,;\n")]
    rows += [(2003, "w1 " * 40_000 + "w2,w3 " * 300_000), (2004, "x" * 2_000_000 + " w4")]
    items = [(0, "w1 W2 w3"), (1, rows[7][1]), (1, "w9 w10"), (None, "é É日本 a1"), (4, None), (5, ""), (6, "unknown words"), (7, "w1 " * 5), (8, "of another")]
    return rows, items


def frames(spark, odd):
    docs = spark.createDataFrame([(*r, 5, "q", [1]) for r in odd[0]], "doc_id long, text string, score int, query string, terms array<int>")
    return docs, spark.createDataFrame([(*r, 1) for r in odd[1]], "item_id long, text string, rank int")


def test_search_equals_brute_force(spark, odd, monkeypatch):
    docs, items = frames(spark, odd)
    want = brute(*odd)
    assert found(ball_search.search(docs.repartition(3), items)) == want
    monkeypatch.setattr(ball_search, "BLOCK_ROWS", 90)
    monkeypatch.setattr(ball_search, "LEAF_ROWS", 4)
    monkeypatch.setattr(ball_search, "ITEMS", 4)
    monkeypatch.setattr(ball_search, "TERMS", 5)
    assert found(ball_search.search(docs.coalesce(1), items)) == want
    assert found(ball_search.search(docs, items, k=3)) == brute(*odd, k=3)


def test_search_of_nothing(spark, odd):
    docs, items = frames(spark, odd)
    assert ball_search.search(docs.limit(0), items).count() == 0
    assert ball_search.search(docs, items.limit(0)).count() == 0
    assert ball_search.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def random_tree(seed, n=700, width=80):
    rng = np.random.default_rng(seed)
    weight = rng.integers(0, 12_000, width)
    lists = [np.sort(rng.choice(width // 2, rng.integers(0, 20), replace=False)) + (width // 2) * (i % 2) for i in range(n)]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    terms = np.concatenate(lists)
    values = rng.integers(1, 1_000_000, len(terms))
    tree, order = ball_search.Tree.over(starts, terms, values, weight)
    queries = ball_search.Queries([])
    queries.terms = [rng.choice(width // 2, 6, replace=False) + (width // 2) * (q % 2) for q in range(20)]
    dense = np.zeros((n, width), np.int64)
    dense[np.repeat(np.arange(n), np.diff(starts)), terms] = values
    return tree, order, queries, weight, dense


@pytest.mark.parametrize("seed", range(3))
def test_bounds_hold_and_prune(seed):
    tree, order, queries, weight, dense = random_tree(seed)
    bounds = tree.bounds(queries, weight)
    assert sorted(order.tolist()) == list(range(len(dense)))
    for q, own in enumerate(queries.terms):
        scores = (dense[:, own] * weight[own]).sum(1)[order]
        for node in range(len(tree.first)):
            assert scores[tree.first[node] : tree.last[node]].max() <= bounds[node, q]
        weight_of = np.zeros(len(weight), np.int64)
        weight_of[own] = weight[own]
        visited = []
        tree.starts = Counted(tree.starts, visited)
        got, names = tree.best(bounds[:, q], weight_of, 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0)
        tree.starts = tree.starts.values
        least = np.sort(scores)[-10]
        assert sorted(zip(got.tolist(), names.tolist())) == sorted((s, i) for i, s in enumerate(scores.tolist()) if s >= least)
        assert len(visited) < np.count_nonzero(tree.left == 0)  # half of the texts share no term with the query


class Counted:
    """An array that notes the slices read from it, one per leaf."""

    def __init__(self, values, seen):
        self.values, self.seen = values, seen

    def __getitem__(self, key):
        if isinstance(key, slice):
            self.seen.append(key)
        return self.values[key]


def test_terms_equal_the_pattern():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aZ09éÉ_-[]{}@`~ \n\t\x00\x7f\x85日😀") for _ in range(rng.randrange(30)))
        assert [t.decode() for part in ball_search.terms(text.encode()) for t in part] == terms(text)
