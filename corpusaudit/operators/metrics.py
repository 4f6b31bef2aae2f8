"""Before and after: complexity, security, performance and changed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions.diffs import changed_lines, unified_diff
from corpusaudit.functions.pyast import syntax
from corpusaudit.functions.text import (
    count_ignoring_case,
    count_of,
    has,
    indent_of,
    let,
    odd_case,
    py_lstrip,
    py_strip,
    rows_of,
    split_lines,
)
from corpusaudit.operators import rules
from corpusaudit.operators.lines import loop_count
from corpusaudit.operators.scan import vulnerability_count
from corpusaudit.sources.files import language_of

# What adds to the complexity, and the gain of each kind of improvement.
BRANCH_WORDS = ("if ", "for ", "while ", "try:", "except ", "def ")
COMPREHENSION_GAIN, ENUMERATE_GAIN, GENERATOR_GAIN = 0.2, 0.1, 0.3


def complexity(code: Column) -> Column:
    """0 for a blank text, else 1 + branch words + deepest indent / 4."""
    words = [count_of(code, word) for word in BRANCH_WORDS]
    deepest = F.array_max(
        F.transform(
            split_lines(code),
            lambda line: F.when(py_lstrip(line) == "", 0).otherwise(indent_of(line)),
        )
    )
    score = F.lit(1.0) + sum(words[1:], words[0]) + deepest / 4
    return F.when(py_strip(code) == "", 0.0).otherwise(score)


def complexity_report(files: DataFrame) -> DataFrame:
    return files.select("file_id", complexity(F.col("code")).alias("complexity"))


def complexity_delta(before: Column, after: Column) -> Column:
    return F.when(before == after, 0.0).otherwise(complexity(after) - complexity(before))


def _issue_count(code: Column) -> Column:
    def total(v: Column) -> Column:
        parts = [
            F.when(
                has(v["low"], needle) | v["odd"],
                count_ignoring_case(code, v["low"], v["odd"], pattern),
            ).otherwise(0)
            for needle, pattern in rules.IMPROVEMENTS
        ]
        return sum(parts[1:], parts[0])

    return let(F.struct(F.lower(code).alias("low"), odd_case(code).alias("odd")), total)


def security_improvements(before: Column, after: Column) -> Column:
    gone = F.when(before == after, 0).otherwise(_issue_count(before) - _issue_count(after))
    return F.greatest(F.lit(0), gone).cast("long")


def performance_gains(before: Column, after: Column) -> Column:
    fewer_appends = count_of(before, "append") > count_of(after, "append")
    comprehension = has(after, "[") & has(after, "for") & fewer_appends
    enumerated = has(after, "enumerate") & has(before, "range(len(")
    generator = has(after, "yield") & has(before, "return")
    return (
        F.when(comprehension, COMPREHENSION_GAIN).otherwise(0.0)
        + F.when(enumerated, ENUMERATE_GAIN).otherwise(0.0)
        + F.when(generator, GENERATOR_GAIN).otherwise(0.0)
    )


def line_balance(before: Column, after: Column) -> Column:
    """Lines added or removed, counted as multisets. Edits replace lines where they stand, so no
    alignment is needed: both texts' lines are sorted together and folded once."""

    def signed(code: Column, sign: int) -> Column:
        return F.transform(split_lines(code), lambda line: F.struct(line.alias("line"), F.lit(sign).alias("sign")))

    def step(acc: Column, entry: Column) -> Column:
        same = acc["line"] == entry["line"]
        return F.struct(
            entry["line"].alias("line"),
            (F.when(same, acc["run"]).otherwise(0) + entry["sign"]).alias("run"),
            (acc["total"] + F.when(same, 0).otherwise(F.abs(acc["run"]))).alias("total"),
        )

    start = F.struct(F.lit("").alias("line"), F.lit(0).alias("run"), F.lit(0).alias("total"))
    entries = F.array_sort(F.concat(signed(before, 1), signed(after, -1)))
    balance = F.aggregate(entries, start, step, lambda acc: acc["total"] + F.abs(acc["run"]))
    return F.when(before != after, balance).otherwise(0)


def refactor_metrics(results: DataFrame) -> DataFrame:
    """(file_id, lines_changed, complexity_delta, security_improvements, performance_gains) of refactored
    files, whose lines were counted in order while they were edited."""
    before, after = F.col("original_code"), F.col("refactored_code")
    return results.select(
        "file_id",
        "lines_changed",
        complexity_delta(before, after).alias("complexity_delta"),
        security_improvements(before, after).alias("security_improvements"),
        performance_gains(before, after).alias("performance_gains"),
    )


def lines_changed_multiset(pairs: DataFrame) -> DataFrame:
    """Lines added or removed in texts that changed: a lower bound of the exact count, taken in the
    file's own row."""
    before, after = F.col("original_code"), F.col("refactored_code")
    row = F.struct(line_balance(before, after).alias("lines_changed"))
    return pairs.select("file_id", rows_of(before != after, row))


def lines_changed_exact(results: DataFrame) -> DataFrame:
    """Lines removed and added by the edits, in order."""
    return results.select("file_id", "lines_changed")


def lines_changed_of_pairs(pairs: DataFrame) -> DataFrame:
    """The same count for any two texts, without the edits that lead from one to the other."""
    n = changed_lines(F.col("original_code"), F.col("refactored_code"))
    return pairs.select("file_id", n.alias("lines_changed"))


def diffs(pairs: DataFrame) -> DataFrame:
    diff = unified_diff(F.col("original_code"), F.col("refactored_code"))
    return pairs.select("file_id", diff.alias("diff"))


def syntax_report(files: DataFrame) -> DataFrame:
    """Python files must parse; other files must not be blank."""
    is_python = language_of(F.col("path")) == "python"
    # The parser only sees Python: other texts reach it as an empty string.
    parsed = files.select(
        "file_id",
        "path",
        is_python.alias("is_python"),
        (py_strip(F.col("code")) != "").alias("non_blank"),
        syntax(F.when(is_python, F.col("code")).otherwise("")).alias("syntax"),
    )
    valid = F.when(F.col("is_python"), F.col("syntax.valid")).otherwise(F.col("non_blank"))
    return parsed.select("file_id", "path", valid.alias("valid"))


def cyclomatic(files: DataFrame) -> DataFrame:
    return files.select("file_id", syntax(F.col("code")).alias("s")).select(
        "file_id", "s.valid", "s.cyclomatic"
    )


def validate_corpus(files: DataFrame) -> DataFrame:
    """Syntax and complexity of every file, read as Python."""
    return files.select(
        "file_id",
        "path",
        complexity(F.col("code")).alias("complexity"),
        syntax(F.col("code")).alias("s"),
    ).select("file_id", "path", F.col("s.valid").alias("syntax_valid"), "complexity")


def validate_security(pairs: DataFrame) -> DataFrame:
    """No more vulnerabilities than before, and no critical call that stayed."""
    before, after = F.col("original_code"), F.col("refactored_code")
    stayed = [has(before, call) & has(after, call) for call in rules.CRITICAL_CALLS]
    any_stayed = stayed[0] | stayed[1] | stayed[2]
    fewer = vulnerability_count(after) <= vulnerability_count(before)
    return pairs.select("file_id", (~any_stayed & fewer).alias("valid"))


def validate_pattern(pairs: DataFrame) -> DataFrame:
    """The result parses, is not cosmetic, and the line count moves by at most a fifth."""
    before, after = F.col("original_code"), F.col("refactored_code")
    n_before, n_after = F.size(split_lines(before)), F.size(split_lines(after))
    shift = F.abs(n_after - n_before) / F.greatest(n_before, F.lit(1))
    return pairs.select(
        "file_id",
        ((py_strip(before) != py_strip(after)) & (shift <= 0.2)).alias("sound"),
        syntax(after).alias("s"),
    ).select("file_id", (F.col("sound") & F.col("s.valid")).alias("valid"))


def validate_loop(pairs: DataFrame) -> DataFrame:
    """The result parses and has at most 1.2 times the loops."""
    before, after = F.col("original_code"), F.col("refactored_code")
    few = loop_count(after) <= loop_count(before) * F.lit(1.2)
    return pairs.select("file_id", few.alias("few"), syntax(after).alias("s")).select(
        "file_id", (F.col("few") & F.col("s.valid")).alias("valid")
    )
