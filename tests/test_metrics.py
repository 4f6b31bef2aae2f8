import ast
import difflib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusaudit.config import AuditConfig
from corpusaudit.operators import metrics, script
from corpusaudit.operators.sessions import result_report
from corpusaudit.plans.refactor import refactor
from corpusaudit.sources.derived import SNIPPETS
from tests import fuzz


@pytest.fixture(scope="module")
def pairs(spark):
    codes = fuzz.texts(240, seed=21)
    rows = [(i, "m.py", a, b) for i, (a, b) in enumerate(zip(codes[::2], codes[1::2]))]
    rows += [(1000 + i, "m.py", c, c) for i, c in enumerate(codes[:10])]
    df = spark.createDataFrame(
        rows, "file_id bigint, path string, original_code string, refactored_code string"
    ).cache()
    return df, {r[0]: (r[2], r[3]) for r in rows}


def test_line_diffs_follow_difflib(pairs):
    df, texts = pairs
    exact = {r.file_id: r.lines_changed for r in metrics.lines_changed_of_pairs(df).collect()}
    diff = {r.file_id: r.diff for r in metrics.diffs(df).collect()}
    bound = {r.file_id: r.lines_changed for r in metrics.lines_changed_multiset(df).collect()}
    for i, (a, b) in texts.items():
        marks = list(difflib.Differ().compare(a.split("\n"), b.split("\n")))
        assert exact[i] == sum(m.startswith(("+ ", "- ")) for m in marks)
        lines = difflib.unified_diff(
            a.splitlines(True), b.splitlines(True), "original", "modified", lineterm=""
        )
        assert diff[i] == "".join(lines)
        assert bound.get(i, 0) <= exact[i]


def test_line_balance_counts_multisets(pairs):
    df, texts = pairs
    for file_id, n in metrics.lines_changed_multiset(df).collect():
        before, after = (Counter(t.split("\n")) for t in texts[file_id])
        assert n == ((before - after) + (after - before)).total()


def test_line_balance_of_repeated_lines(spark):
    before = "\n".join(["a = 1", "b = 2", "c = 3"] * 20_000)
    after = before.replace("b = 2", "b = 4", 1) + "\nd = 5"
    df = spark.createDataFrame(
        [(1, before, after), (3, "", "x")], "file_id bigint, original_code string, refactored_code string"
    )
    found = {r.file_id: r.lines_changed for r in metrics.lines_changed_multiset(df).collect()}
    assert found == {1: 3, 3: 2}


@pytest.mark.parametrize("cfg", [AuditConfig(), AuditConfig(multi_line=True), AuditConfig(keep_indent=True, max_iterations=30)])
def test_changed_lines_are_counted_in_order(corpus_of, cfg):
    """The count from the edits equals a line-by-line comparison of the texts."""
    rows = refactor(corpus_of(*fuzz.texts(1200, seed=33), "", None).repartition(8), cfg).collect()
    changed = 0
    for r in rows:
        if r.original_code is None:
            assert r.lines_changed == 0
            continue
        marks = difflib.Differ().compare(r.original_code.split("\n"), r.refactored_code.split("\n"))
        assert r.lines_changed == sum(m.startswith(("+ ", "- ")) for m in marks)
        changed += r.lines_changed > 0
    assert changed > 400


def test_moved_and_exchanged_lines_count(spark):
    rows = [(1, "a b c", "b a c", [1, 0, 2]), (2, "a b", "b a", [-1, -1]), (3, "a b c", "a x c", [0, -1, 2]), (4, "a b", "a b", [0, 1]), (5, "a b c", "c", [2])]
    df = spark.createDataFrame(rows, "i int, a string, b string, origin array<int>")
    n = script.lines_changed(F.split("a", " "), F.split("b", " "), F.col("origin"))
    assert {r.i: r.n for r in df.select("i", n.alias("n")).collect()} == {1: 0, 2: 2, 3: 2, 4: 0, 5: 2}


def test_cyclomatic_counts_branches(corpus_of):
    codes = {
        "x = 1": 1,
        "if a:\n    pass\nelif b:\n    pass\nelse:\n    pass": 3,
        "for x in y:\n    while z:\n        pass": 3,
        "async def f():\n    async for x in y:\n        pass": 2,
        "try:\n    pass\nexcept A:\n    pass\nexcept B:\n    pass": 3,
        "try:\n    pass\nexcept* A:\n    pass": 1,
        "x = 1 if y else 2": 1,
        "z = [a for a in b if a]": 1,
        "": 1,
        "def invalid syntax here +++": None,
        "(" * 500: None,
        "x = '\\d'": 1,
    }
    rows = metrics.cyclomatic(corpus_of(*codes)).orderBy("file_id").collect()
    assert [r.cyclomatic for r in rows] == list(codes.values())
    assert [r.valid for r in rows] == [v is not None for v in codes.values()]


def test_syntax_by_language(spark):
    files = spark.createDataFrame(
        [(1, "a.py", "x ="), (2, "a.js", "x ="), (3, "a.go", " \n"), (4, "b.py", "")],
        "file_id bigint, path string, code string",
    )
    rows = {r.file_id: r.valid for r in metrics.syntax_report(files).collect()}
    assert rows == {1: False, 2: True, 3: False, 4: True}


def test_syntax_agrees_with_the_parser(corpus_of):
    codes = fuzz.texts(150, seed=23)
    got = {r.file_id: r.syntax_valid for r in metrics.validate_corpus(corpus_of(*codes)).collect()}

    def parses(code):
        try:
            ast.parse(code)
        except SyntaxError:
            return False
        return True

    assert got == {i: parses(c) for i, c in enumerate(codes)}


def test_complexity(corpus_of):
    codes = {
        "": 0.0,
        " \n\t": 0.0,
        "x": 1.0,
        SNIPPETS[4]: 3.0,
        "def f():\n    if a:\n        try:\n            pass\n        except E:\n            pass": 8.0,
        "  x": 1.5,
    }
    rows = metrics.complexity_report(corpus_of(*codes)).orderBy("file_id").collect()
    assert [r.complexity for r in rows] == list(codes.values())


def test_metrics_of_a_run(corpus_of):
    files = corpus_of('password = "hunter2_longpass"', SNIPPETS[4])
    rows = {r.file_id: r for r in metrics.refactor_metrics(refactor(files)).collect()}
    assert (rows[0].lines_changed, rows[0].security_improvements) == (2, 1)
    assert rows[0].complexity_delta == 0.0
    assert (rows[1].lines_changed, rows[1].performance_gains) == (2, pytest.approx(0.1))
    report = {r.file_id: r for r in result_report(refactor(files)).collect()}
    assert report[0].changes == (
        "security_enforcer: Move hardcoded password to environment variable (confidence: 0.80)"
    )
    assert (report[1].n_steps, report[1].lines_changed) == (1, 2)


def test_performance_gains(spark):
    df = spark.createDataFrame(
        [("out.append(x)\nfor", "[x for x in y]"), ("range(len(", "enumerate"), ("return", "yield"),
         ("a", "b")],
        "a string, b string",
    )
    gains = df.select(metrics.performance_gains(F.col("a"), F.col("b")).alias("g")).collect()
    assert [g.g for g in gains] == pytest.approx([0.2, 0.1, 0.3, 0.0])


def test_validation_of_results(spark):
    rows = [
        (1, "x = 1\ny = 2", "x = 1\ny = 3"),
        (2, "x = 1", "x = 1 "),
        (3, "x = 1", "x ="),
        (4, "\n".join(["x = 1"] * 5), "\n".join(["x = 1"] * 6)),
        (5, "\n".join(["x = 1"] * 5), "\n".join(["x = 1"] * 7)),
        (6, "x = 1", "for a in b:\n    pass"),
    ]
    df = spark.createDataFrame(
        rows, "file_id bigint, original_code string, refactored_code string"
    )
    pattern = {r.file_id: r.valid for r in metrics.validate_pattern(df).collect()}
    assert pattern == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
    loop = {r.file_id: r.valid for r in metrics.validate_loop(df).collect()}
    assert loop == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False}


def test_snapshots_of_a_run(corpus_of):
    r = refactor(corpus_of('f = open("../etc/p")'), AuditConfig(max_iterations=3)).first()
    assert [s.iteration for s in r.steps] == [0, 1, 2]


def test_syntax_reads_one_text_at_a_time(spark):
    """Before, every batch was a pandas frame beside its Arrow form."""
    import ast
    import re

    from pyspark.sql import functions as F

    from corpusaudit.functions.pyast import syntax

    texts = ["x = 1", "if x:\n  pass\nelif y:\n  pass", "def (", "", None, "a\x00b", "(" * 300, "é = 'ſ'", "try:\n  pass\nexcept A:\n  pass"] * 40
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", syntax(F.col("t")).alias("s"))
        got = {r.i: (r.s.valid, r.s.cyclomatic) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def parses(text):
        try:
            return text is not None and ast.parse(text) is not None
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return False

    assert [got[i][0] for i in range(len(texts))] == [parses(t) for t in texts]
    assert [got[i][1] for i in range(9)] == [1, 3, None, 1, None, None, None, 1, 2]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ArrowEvalPython .*\], (\d+)", plan).group(1) in ("250", "251")  # Arrow in and out
