"""User patterns and replacements against Python's ``re``."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusaudit.functions.dialect import java_pattern, java_replacement
from corpusaudit.operators import rulepack

RULES = (
    "rule_id string, category string, pattern string, replacement string, confidence double, "
    "impact double, change_type string"
)
PIECES = [
    r"\w", r"\W", r"\s", r"\S", r"\d", r"\D", r"\b", r"\B", ".", ".?", ".{2}", "a{,2}", "{", "}", "[.*]", "[^.*]", r"[\w.-]",
    r"[^\w]", r"[^\S\n]", r"[^\W\d_]", r"[\W_]", r"[\D]", "[[a&&b]", "[]a-c-]", "[^]]", "(a|é)", "(?P<n>b+)", "(?:c)", "a+?", "$", "^",
    r"\Z", r"\t", r"\.", r"\$", "#", " ", r"\x41", r"\u00e9", r"(?=\w)", "(?<!a)", "-", "&", "~",
]
LETTERS = list("aabbcAé_1٣-. \t\n\r\x0b\x1c\x85\u2028$#{}[]*&~ſ")


def test_patterns_find_what_python_finds(spark):
    random.seed(5)
    patterns = []
    while len(patterns) < 150:
        p = random.choice(["", "", "(?i)", "(?s)"]) + "".join(random.choices(PIECES, k=random.randint(1, 4)))
        try:
            re.compile(p)
        except re.error:
            continue
        patterns.append(p)
    texts = ["".join(random.choices(LETTERS, k=random.randint(0, 12))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = df.select("t", *[F.regexp_replace("t", java_pattern(p), "<>").alias(f"p{i}") for i, p in enumerate(patterns)])
    wrong = [
        (p, r.t, r[f"p{i}"], re.sub(p, "<>", r.t))
        for r in rows.collect()
        for i, p in enumerate(patterns)
        if r[f"p{i}"] != re.sub(p, "<>", r.t)
    ]
    assert {w[0]: w for w in wrong} == {}


@pytest.mark.parametrize(
    ("pattern", "replacement"),
    [
        (r"(\w+) = (\w+)", r"\2 = \1"), (r"(?P<a>\w)(?P<b>\d)", r"\g<b>\g<a>0$1"), (r"(a)|b", r"[\1]\g<0>"),
        ("a[.*]b", r"\\ \$ \n x"), (r"(.)\1", "$"), (r"(?P<q>['\"]).*?(?P=q)", "Q"), ("x{,2}y", r"\g<0>\t"),
    ],
)
def test_replacements(spark, pattern, replacement):
    texts = ["x = y1", "aXb a.b a*b", "b a", "aabb", "'a\" b'", "xxxy y", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", F.regexp_replace("t", java_pattern(pattern), java_replacement(replacement, pattern)).alias("o"))
    for r in out.collect():
        assert r.o == re.sub(pattern, replacement, r.t)


@pytest.mark.parametrize("pattern", ["(?m)^a", "(?x)a b", "(?(1)a|b)", "(", r"(a)(?#note)", "(?i:a)", r"\0"])
def test_what_cannot_be_carried_over_is_refused(pattern):
    with pytest.raises(ValueError, match="pattern"):
        java_pattern(pattern)


def test_unknown_groups_are_refused():
    with pytest.raises(ValueError, match="no group 2"):
        java_replacement(r"\2", "(a)")


def test_rule_tables_use_it(spark, corpus_of):
    rules = spark.createDataFrame([("S", "c", r"(\w+) = (\w+)", r"\2 = \1", 0.5, 0.1, "readability")], RULES)
    rows = rulepack.apply_rule_table(corpus_of("a = b"), rules, "u", 3).collect()
    assert [r.modified_code for r in rows] == ["b = a"]
