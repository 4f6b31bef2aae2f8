"""Linear searches against the plain patterns in Python, on dense random texts and on hostile ones."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusaudit.functions import sequences
from corpusaudit.operators import rules, scan
from tests import fuzz

PLAIN = {
    "ternary": (rules.TERNARY, sequences.has_ternary),
    "concat": (rules.CONCAT_IN_LOOP, sequences.has_concat_in_loop),
    "filter": (rules.FILTER_LOOP, sequences.has_filter_loop),
}
PIECES = {
    "ternary": ["if", "if ", "elif x", ":", ": ", "return", "return ", "return\n", "else:", "else: ", "else", " ", "\n", "\t", "x", "a b", "\u2003", "\x85", "\n\n  ", ":\nreturn ", "else:return", "\ue000", "\ue002"],
    "concat": ["for", "for ", "x", ":", ": ", "+=", " += ", "é_1", "\n", " ", "\t", ": x +=", "for\n", "+", "=", "\ue000", "\ue002", "\u3000"],
    "filter": ["for", "for ", " in", "in ", "x", "é1 ", ":", "if", "if ", "\n", " ", "for x in", "for\n", ":\n if\t", "int", "\ue000"],
}


SHAPES = {
    "ternary": ["if", None, ":", None, "return", None, "else:", None, "return"],
    "concat": ["for", None, ":", None, "+=", None],
    "filter": ["for", None, "in", None, ":", None, "if", None],
}


def near_hit(name, rng):
    """The words of the pattern in order, with little or much between them."""
    between = lambda: "".join(rng.choices([" ", "\n", "x", *PIECES[name]], k=rng.choice([0, 1, 1, 2, 3])))
    return between() + "".join(part if part else between() for part in SHAPES[name]) + between()


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_found_where_the_pattern_matches(spark, name):
    pattern, search = PLAIN[name]
    rng = random.Random(name)
    texts = ["".join(rng.choices(PIECES[name], k=rng.randrange(1, 14))) for _ in range(30_000)] + fuzz.texts(500)
    texts += [near_hit(name, rng) for _ in range(60_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", search(F.col("t")).alias("found"))
    rows = df.collect()
    wrong = [(r.t, r.found) for r in rows if r.found != (re.search(pattern, r.t) is not None)]
    assert not wrong[:3]
    assert 0.02 < sum(r.found for r in rows) / len(rows) < 0.95


def test_calls_are_the_same(spark, corpus_of):
    rng = random.Random(1)
    pieces = ["subprocess.", "run", "(", ")", "+", "a", "\n", " ", "subprocess.x(a + b)", "Subprocess.", "ſubprocess.(", "("]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 16))) for _ in range(20_000)] + ["subprocess.\ue004(\ue004+"]
    pattern = next(v.pattern for v in rules.VULNERABILITIES if v.rule_id == "R5")
    rows = scan.vuln_matches(corpus_of(*texts)).filter("rule_id = 'R5'").collect()
    want = sorted((i, n, m) for i, t in enumerate(texts) for n, m in enumerate(re.findall(pattern, t, re.IGNORECASE)))
    assert sorted((r.file_id, r.match_no, r.matched) for r in rows) == want
    counts = {r.file_id: r.n_matches for r in scan.vuln_counts(corpus_of(*texts)).filter("rule_id = 'R5'").collect()}
    assert counts == {i: n for i, t in enumerate(texts) if (n := len(re.findall(pattern, t, re.IGNORECASE)))}


HOSTILE = {
    "ternary": ["if x:return a ", "if x:\nreturn a\n", "if ", ":return a ", "if x:return ", "if\n", "if x:return\n\n", "else:return if a:return b\n", "if x" + ":" * 50, "if x:return  \n  \n "],
    "concat": ["for x:", "for ", "for x: a ", ":a ", "for\n", "for x:a  "],
    "filter": ["for x in a:", "for x ", "for x in ", "for\nx in", ":if", "for x in a: i"],
    "call": ["subprocess.x(", "subprocess.", "subprocess.x(a", "(", "subprocess.x(+", "subprocess.(a)"],
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_time_follows_the_length(spark, name):
    """A megabyte of half matches takes seconds."""
    for unit in HOSTILE[name]:
        text = unit * (1_000_000 // len(unit))
        df = spark.createDataFrame([(1, "m.py", text)], "file_id long, path string, code string")
        start = time.time()
        if name == "call":
            scan.vuln_counts(df).filter("rule_id = 'R5'").collect()
        else:
            df.select(PLAIN[name][1](F.col("code"))).collect()
        assert time.time() - start < 5, unit
