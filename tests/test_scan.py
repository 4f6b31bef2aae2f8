import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusaudit.functions.text import block_end, block_indents, jre, split_lines
from corpusaudit.operators import lines, rules, scan
from tests import fuzz

SEQUENCES = {
    "infinite_loop_with_break": r"while\s+True.*\n.*if.*break",
    "manual_counting": r"count\s*=\s*0.*for.*count\s*\+=\s*1",
    "manual_sum": r"sum\s*=\s*0.*for.*sum\s*\+=",
}
WHOLE_TEXT = {
    "ternary_operator_opportunity": rules.TERNARY,
    "string_concat_in_loop": rules.CONCAT_IN_LOOP,
    "dict_get_opportunity": rules.DICT_GET,
    "range_len_pattern": rules.RANGE_LEN,
    "nested_loop_with_append": rules.NESTED_APPEND,
    "filter_opportunity": rules.FILTER_LOOP,
    "map_opportunity": rules.MAP_LOOP,
}


@pytest.fixture(scope="module")
def codes():
    return fuzz.texts(1200, seed=11)


@pytest.fixture(scope="module")
def files(corpus_of, codes):
    return corpus_of(*codes).repartition(8).cache()


def test_every_rule_counts_as_its_pattern(files, codes):
    """The rewritten searches find what the plain patterns find, rule by rule."""
    got = {
        (r.file_id, r.rule_id): r.n_matches for r in scan.vuln_counts(files).collect()
    }
    want = {
        (i, r.rule_id): len(re.findall(r.pattern, code, re.IGNORECASE))
        for i, code in enumerate(codes)
        for r in rules.VULNERABILITIES
    }
    assert got == {k: n for k, n in want.items() if n}
    assert {k[1] for k in got} == {r.rule_id for r in rules.VULNERABILITIES}


def test_matched_texts(files, codes):
    got: dict = {}
    for r in scan.vuln_matches(files).orderBy("file_id", "rule_id", "match_no").collect():
        got.setdefault((r.file_id, r.label), []).append(r.matched)
    for i, code in enumerate(codes):
        for r in rules.VULNERABILITIES:
            found = re.findall(r.pattern, code, re.IGNORECASE)
            assert got.get((i, f"{r.category}:{r.pattern}"), []) == found


def test_whole_text_issues(files, codes):
    found = scan.detect_loop_issues(files).unionByName(scan.detect_pattern_issues(files))
    got = {(r.file_id, r.issue): r.n_found for r in found.collect()}
    for i, code in enumerate(codes):
        for name, pattern in WHOLE_TEXT.items():
            assert ((i, name) in got) == bool(re.search(pattern, code))
        for name, pattern in SEQUENCES.items():
            assert ((i, name) in got) == bool(re.search(pattern, code, re.DOTALL))
        assert ((i, "excessive_nested_loops") in got) == (
            code.count("for ") + code.count("while ") > 3
        )
        parts = code.split("\n")
        pairs = sum("for" in a and ".append(" in b for a, b in zip(parts, parts[1:]))
        assert got.get((i, "list_comprehension_opportunity"), 0) == pairs
        temps = sum(bool(re.match(r"\s*(temp_|tmp_|temporary_)\w+\s*=", p)) for p in parts)
        assert got.get((i, "unnecessary_temp_variable"), 0) == temps
    assert {k[1] for k in got} == set(rules.PATTERN_ISSUES) | set(rules.LOOP_ISSUES)


def test_sequence_parts_may_not_overlap_or_swap(corpus_of):
    texts = ["for x\nsum = 0\nsum += x", "sum = 0 for sum +=", "sum = 0\nsum += 1\nfor x"]
    found = scan.detect_loop_issues(corpus_of(*texts)).filter("issue = 'manual_sum'")
    assert [r.file_id for r in found.collect()] == [1]


def test_block_ends(files, codes):
    got = {(r.file_id, r.line_no): r.end_line for r in lines.block_ends(files).collect()}
    want = {}
    for i, code in enumerate(codes):
        parts = code.split("\n")
        depth = [len(p) - len(p.lstrip()) if p.strip() else 10**9 for p in parts]
        for s, part in enumerate(parts):
            if re.search(r"while\s+True:", part):
                later = [j for j in range(s + 1, len(parts)) if depth[j] <= depth[s]]
                want[i, s] = (later[0] if later else len(parts)) - 1
    assert got == want and want


@pytest.mark.parametrize(
    "text",
    [
        "sum = 0 for x\n" * 40000,
        "count = 0 for x\n" * 40000,
        "while True\nif x\n" * 40000,
        "while True:\n    pass\n" * 40000,
    ],
)
def test_hostile_texts_stay_linear(corpus_of, text):
    files = corpus_of(text)
    start = time.time()
    scan.detect_loop_issues(files).collect()
    lines.block_ends(files).write.format("noop").mode("overwrite").save()
    assert time.time() - start < 30


@pytest.mark.parametrize("call", ["eval(x ", "exec(y % ", "cursor.execute(z ", "os.system(a "])
def test_unclosed_calls_stay_linear(corpus_of, call):
    start = time.time()
    scan.vuln_counts(corpus_of(call * 30000)).collect()
    assert time.time() - start < 30


def test_long_blocks(spark):
    """The widening search finds ends beyond each of its steps."""
    bodies = [1, 15, 16, 17, 300, 600, 20000]
    code = "\n".join("while True:\n" + "\n".join(["    x"] * n) for n in bodies)
    df = spark.createDataFrame([(code,)], "code string").select(
        split_lines(F.col("code")).alias("lines")
    )
    df = df.select("lines", block_indents(F.col("lines")).alias("indents"))
    start, want = 0, []
    for n in bodies:
        want.append((start, start + n))
        start += n + 1
    got = df.select(
        F.transform(
            F.array(*[F.lit(s) for s, _ in want]), lambda s: block_end(F.col("indents"), s)
        ).alias("e")
    ).first()
    assert got.e == [e for _, e in want]


def test_unicode_words_and_spaces(spark):
    df = spark.createDataFrame([("élan = 0",), ("x\u3000=\u00a00",)], "t string")
    pattern = jre(r"(\w+)\s*=\s*0")
    assert [r.g for r in df.select(F.regexp_extract("t", pattern, 1).alias("g")).collect()] == [
        "élan",
        "x",
    ]


def test_demo_snippets(corpus_of):
    files = corpus_of(
        'password = "hunter2_longpass"',
        "for i in range(len(items)):\n    print(items[i])",
        "",
    )
    found = {
        (r.file_id, r.agent_id): (r.issues_found, r.confidence)
        for r in scan.findings_per_agent(files).collect()
    }
    assert found[0, "security_enforcer"] == (1, 0.9)
    assert found[1, "loop_simplifier"] == (1, 0.8)
    assert found[2, "security_enforcer"] == (0, 0.7)
    assert found[2, "pattern_optimizer"] == (0, 0.5)


def test_loop_searches_find_what_the_plain_patterns_find():
    random.seed(11)
    parts = ["for ", "for x in ", ":", "\n", ".append", "x.append(", "y", ")", "(", " ", "()"]
    for _ in range(20_000):
        text = "".join(random.choices(parts, k=random.randint(3, 14)))
        for plain, search in ((rules.NESTED_APPEND, rules.NESTED_APPEND_SEARCH), (rules.MAP_LOOP, rules.MAP_LOOP_SEARCH)):
            assert bool(re.search(plain, text)) == bool(re.search(search, text)), (plain, text)


def test_hostile_lines_of_loops_are_read_fast(spark, corpus_of):
    files = corpus_of(
        "for " * 100_000 + "\n" + "for " * 100_000 + "\n.appen",
        "for x in y: z.append(" + "a" * 20_000,
    )
    start = time.time()
    assert "nested_loop_with_append" not in {r.issue for r in scan.detect_loop_issues(files).collect()}
    assert time.time() - start < 20
