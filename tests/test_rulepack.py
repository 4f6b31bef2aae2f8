import random
import re

import pytest
from pyspark.sql import functions as F

from corpusaudit.functions.literals import grams_in, grams_pattern, required_literals
from corpusaudit.operators import consensus, lines, propose, rulepack

RULES = (
    "rule_id string, category string, pattern string, replacement string, confidence double, "
    "impact double, change_type string"
)


def table(spark, n):
    return spark.createDataFrame(
        [(f"U{i:04d}", "names", rf"\bname{i}\b", f"n{i}", 0.7, 0.2, "readability") for i in range(n)],
        RULES,
    )


def test_data_rules_become_proposals_that_can_be_voted_on(spark, corpus_of):
    files = corpus_of("x = name1\nname2 = name1", "nothing")
    p = rulepack.apply_rule_table(files, table(spark, 3), "names", 3)
    got = sorted((r.rule_id, r.line_start, r.modified_code) for r in p.collect())
    assert got == [("U0001", 0, "x = n1"), ("U0001", 1, "name2 = n1"), ("U0002", 1, "n2 = name1")]
    both = propose.proposals(files).unionByName(p)
    d = {r.file_id: r.decision for r in consensus.consensus(files, both).collect()}
    assert d == {0: "reject_changes", 1: "no_changes"}


def test_plan_does_not_grow_with_the_rules(spark, corpus_of):
    n = 20_000
    files = corpus_of("\n".join(f"name{i}" for i in range(0, n, 400)), "no such thing", None, "")
    few, many = (rulepack.apply_rule_table(files, table(spark, k), "names", 3) for k in (3, n))

    def shape(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [line.strip(" +-:*()0123456789").split(" ")[0] for line in plan.splitlines()]

    assert shape(few) == shape(many) and len(shape(many)) < 40
    rows = many.collect()
    assert sorted(r.line_start for r in rows) == list(range(n // 400))
    assert sorted((r.rule_id, r.rule_ord) for r in rows) == [(f"U{i:04d}", place_of(i, n)) for i in sorted(range(0, n, 400), key=lambda i: f"U{i:04d}")]
    counted = rulepack.scan_rule_table(files, table(spark, n)).collect()
    assert len(counted) == n // 400 and {r.n_matches for r in counted} == {1}


def test_larger_tables_take_several_passes(spark, corpus_of, monkeypatch):
    monkeypatch.setattr(rulepack, "RULES_AT_ONCE", 7)
    p = rulepack.apply_rule_table(corpus_of("\n".join(f"name{i}" for i in range(20))), table(spark, 20), "names", 3).collect()
    assert sorted((r.line_start, r.rule_ord) for r in p) == [(i, i) for i in range(20)]


def place_of(i, n):
    return sorted(f"U{k:04d}" for k in range(n)).index(f"U{i:04d}")


PATTERNS = [
    r"\bname1\b", r"a\s+b", r"(?i)TODO|fixme", r"x", r"[a-z]+\(\)", r"(foo|ba[rz])\s*=", r"(?:print|log)\(.*\)", r"return None$", r"(ab){2,}", r"éte|abc",
    r"(?i)straße|ISBN", r"^import (os|sys)", r"if .+: pass", r"a?bcd", r"(?=abc)a", r"[Tt]emp_\w+", r"x{0}yyy|zzz", r"\.append\(",
]


def test_index_loses_no_match(spark, corpus_of):
    rng = random.Random(8)
    words = ["name1", "a  b", "todo", "FIXME", "ſtraße", "ISBN", "ıſbn", "İSBN", "STRASSE", "foo =", "bar=", "print(x)", "log( )", "return None", "abab", "éte", "abc", "import os", "if x: pass", "bcd", "Temp_1", "yyy", "zzz", "x.append(1)", "f()", "\n", " "]
    texts = ["".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(400)]
    rules = spark.createDataFrame([(f"P{i:02d}", "c", p, "", 0.5, 0.1, "readability") for i, p in enumerate(PATTERNS)], RULES)
    want = sorted((k, f"P{i:02d}", len(re.findall(p, t))) for k, t in enumerate(texts) for i, p in enumerate(PATTERNS) if re.search(p, t))
    got = rulepack.scan_rule_table(corpus_of(*texts), rules).collect()
    assert sorted((r.file_id, r.rule_id, r.n_matches) for r in got) == want
    lines_hit = sorted(
        (k, f"P{i:02d}", n, re.sub(p, "", line)) for k, t in enumerate(texts) for n, line in enumerate(t.split("\n"))
        for i, p in enumerate(PATTERNS) if re.search(p, line)
    )
    got = rulepack.apply_rule_table(corpus_of(*texts), rules, "u", 3).collect()
    assert sorted((r.file_id, r.rule_id, r.line_start, r.modified_code) for r in got) == lines_hit


def test_required_literals():
    assert required_literals(r"\bname17\b") == ["name17"]
    assert required_literals(r"(?i)TODO|fixme") == ["fixme", "todo"]
    assert required_literals(r"(foo|ba[rz])\s*=") == [] and required_literals(r"[a-z]+") == []
    assert required_literals(r"\s*(import|from) (os)") == ["from", "import"]
    assert required_literals(r"(abc)?xyz1") == ["xyz1"]


def test_rule_tables_search_whole_texts(spark, corpus_of):
    rules = spark.createDataFrame(
        [("W1", "c", r"a\s+b", "", 0.5, 0.1, "readability")], RULES
    )
    rows = rulepack.scan_rule_table(corpus_of("a\nb a  b", "ab"), rules).collect()
    assert [(r.file_id, r.n_matches) for r in rows] == [(0, 2)]


def test_builtin_rules_win(spark):
    builtin = table(spark, 2)
    user = table(spark, 4).withColumn("replacement", F.lit("other"))
    merged = {r.rule_id: r.replacement for r in rulepack.merge_rules(builtin, user).collect()}
    assert merged == {"U0000": "n0", "U0001": "n1", "U0002": "other", "U0003": "other"}


def test_packs_are_checked(corpus_of):
    files = corpus_of("todo")

    def good(f):
        return lines.code_lines(f).filter("line = 'todo'").select(
            "file_id",
            F.lit("todo").alias("agent_id"),
            F.lit(9).alias("agent_ord"),
            F.lit("T1").alias("rule_id"),
            F.lit(1).alias("rule_ord"),
            F.lit("structure").alias("change_type"),
            F.col("line").alias("original_code"),
            F.lit("done").alias("modified_code"),
            F.col("line_no").alias("line_start"),
            F.col("line_no").alias("line_end"),
            F.lit(0.5).alias("confidence"),
            F.lit("finish").alias("description"),
            F.lit(0.1).alias("impact_score"),
        )

    def pack(make):
        return rulepack.RulePack(
            "todo", lines.code_lines, make, lambda f: f("confidence"), lambda a, b: a != b
        )

    proposed = rulepack.propose_with(pack(good), files)
    assert proposed.first().modified_code == "done"
    voters = {"todo": pack(good).vote}
    d = consensus.consensus(files, proposed, 0.6, ("todo", "pattern_optimizer"), voters=voters)
    assert d.first().confidence == pytest.approx(1 - (0.5 + 0.4) / 2)
    pairs = files.select("file_id", F.col("code").alias("original_code"), F.lit("done").alias("refactored_code"))
    assert rulepack.validate_with(pack(good), pairs).first().valid
    with pytest.raises(TypeError, match="confidence"):
        rulepack.propose_with(pack(lambda f: good(f).drop("confidence")), files)
    with pytest.raises(TypeError, match="line_start"):
        rulepack.propose_with(
            pack(lambda f: good(f).withColumn("line_start", F.col("line_start").cast("long"))), files
        )


def test_rule_ids_are_unique_and_present(spark, corpus_of):
    schema = "rule_id string, category string, pattern string"
    for rules in ([("a", "c", "x"), ("a", "c", "y")], [(None, "c", "x")]):
        with pytest.raises(ValueError, match="not unique"):
            rulepack.scan_rule_table(corpus_of("x"), spark.createDataFrame(rules, schema))


def test_only_strings_of_the_index_are_looked_up(spark):
    """Before, every distinct string of a text became a row beside the whole text."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab]^\\-\n .é", k=200)) for _ in range(60)] + ["", None]
    grams = {t[i : i + 3] for t in texts[:3] for i in range(0, 150, 7)}
    for wanted in (grams, set(list(grams)[:1]), set()):
        wanted = {g for g in wanted if g.isascii()}
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", grams_in(F.col("t"), grams_pattern(wanted)).alias("g"))
        for r in df.collect():
            want = None if r.t is None else sorted(wanted & {r.t[i : i + 3] for i in range(len(r.t) - 2)})
            assert (r.g if r.g is None else sorted(r.g)) == want


def test_patterns_of_rules_are_kept_between_lines(spark, corpus_of):
    """``rlike`` compiles a pattern that is not a constant for every line."""
    plan = rulepack.apply_rule_table(corpus_of("name1"), table(spark, 3), "names", 3)._jdf.queryExecution().executedPlan().toString().lower()
    assert "rlike" not in plan and "regexp_instr" in plan
