"""Detection: the vulnerability scan and the pattern and loop issues, on whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions.sequences import (
    CALL,
    CLOSED,
    has_concat_in_loop,
    has_filter_loop,
    has_ternary,
    open_calls,
    restored,
)
from corpusaudit.functions.text import (
    count_ignoring_case,
    has,
    jre,
    let,
    odd_case,
    split_lines,
)
from corpusaudit.operators import rules
from corpusaudit.operators.lines import loop_count


def _lowered(files: DataFrame, *keep: str) -> DataFrame:
    """Adds the lower-cased text for literal checks, and a flag for texts that need the regex."""
    low, odd = F.lower("code").alias("low"), odd_case(F.col("code")).alias("odd")
    return files.select("file_id", *keep, "code", low, odd)


def _gated(build: Callable[[rules.Vulnerability], Column]) -> Column:
    """``build`` of every rule whose gate and needle the text holds, as one array."""
    low, odd = F.col("low"), F.col("odd")
    groups: dict[str, list[Column]] = {}
    for r in rules.VULNERABILITIES:
        one = F.when(has(low, r.needle) | odd, build(r))
        groups.setdefault(r.gate, []).append(one)
    parts = [F.when(has(low, g) | odd, F.array(*rows)) for g, rows in groups.items()]
    return F.array_compact(F.flatten(F.array_compact(F.array(*parts))))


def _count(code: Column, low: Column, odd: Column, r: rules.Vulnerability) -> Column:
    """Matches of a rule; the calls of R5 are marked first."""
    if r.rule_id != "R5":
        return count_ignoring_case(code, low, odd, rules.linear(r))
    marked = count_ignoring_case(open_calls(code), open_calls(low), odd, CALL)
    return F.when(has(code, CLOSED), count_ignoring_case(code, low, odd, rules.linear(r))).otherwise(marked)


def _matched(code: Column, r: rules.Vulnerability) -> Column:
    def texts(text: Column, pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(jre(pattern, ignore_case=True)), F.lit(1))

    plain = texts(code, rules.linear(r))
    if r.rule_id != "R5":
        return plain
    return F.when(has(code, CLOSED), plain).otherwise(F.transform(texts(open_calls(code), CALL), restored))


def _hit(name: str, label: Callable[[rules.Vulnerability], str]) -> Column:
    """array of (label, category, count) of the rules that match the text."""

    def build(r: rules.Vulnerability) -> Column:
        n = _count(F.col("code"), F.col("low"), F.col("odd"), r)
        return F.struct(
            F.lit(label(r)).alias(name),
            F.lit(r.category).alias("category"),
            n.cast("long").alias("n_matches"),
        )

    return F.filter(_gated(build), lambda h: h["n_matches"] > 0)


def vulnerability_count(code: Column) -> Column:
    """Total number of matches of all vulnerability rules in a text."""

    def total(v: Column) -> Column:
        low, odd = v["low"], v["odd"]
        groups: dict[str, list[Column]] = {}
        for r in rules.VULNERABILITIES:
            n = _count(code, low, odd, r)
            groups.setdefault(r.gate, []).append(F.when(has(low, r.needle) | odd, n).otherwise(0))
        parts = [
            F.when(has(low, g) | odd, sum(counts[1:], counts[0])).otherwise(0)
            for g, counts in groups.items()
        ]
        return sum(parts[1:], parts[0]).cast("long")

    return let(F.struct(F.lower(code).alias("low"), odd_case(code).alias("odd")), total)


def vuln_counts(files: DataFrame) -> DataFrame:
    """(file_id, rule_id, category, n_matches), one row per rule that hits a file."""
    return _lowered(files).select("file_id", F.inline(_hit("rule_id", lambda r: r.rule_id)))


def vuln_by_category(files: DataFrame) -> DataFrame:
    return (
        vuln_counts(files)
        .groupBy("category", "rule_id")
        .agg(F.count("*").alias("n_files"), F.sum("n_matches").alias("n_matches"))
    )


def vuln_matches(files: DataFrame) -> DataFrame:
    """One row per match, with the label category:pattern."""

    def matches(r: rules.Vulnerability) -> Column:
        texts = _matched(F.col("code"), r)

        def row(text: Column, i: Column) -> Column:
            return F.struct(
                F.lit(r.rule_id).alias("rule_id"),
                F.lit(f"{r.category}:{r.pattern}").alias("label"),
                i.cast("long").alias("match_no"),
                text.alias("matched"),
            )

        return F.transform(texts, row)

    return _lowered(files).select("file_id", F.inline(F.flatten(_gated(matches))))


def top_risky_files(files: DataFrame, k: int = 20) -> DataFrame:
    """The k files with the most findings; ties by file id. One narrow pass, then a top-k."""
    scored = files.select("file_id", vulnerability_count(F.col("code")).alias("n_matches"))
    return scored.orderBy(F.desc("n_matches"), "file_id").limit(k)


def _issue(name: str, n: Column) -> Column:
    return F.struct(F.lit(name).alias("issue"), n.cast("long").alias("n_found"))


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _all_in(code: Column, *literals: str) -> Column:
    condition = has(code, literals[0])
    for literal in literals[1:]:
        condition = condition & has(code, literal)
    return condition


def pattern_issues(code: Column, lines: Column) -> Column:
    """Array of (issue, n_found) of the pattern optimizer."""
    list_sites = F.size(
        F.filter(
            lines,
            lambda line, i: has(line, "for")
            & F.coalesce(has(F.get(lines, i + 1), ".append("), F.lit(False)),
        )
    )
    temp_sites = F.size(
        F.filter(lines, lambda line: has(line, "_") & line.rlike(jre(rules.TEMP_VARIABLE)))
    )
    counts = (
        F.when(_all_in(code, "for", ".append("), list_sites).otherwise(0),
        _flag(_all_in(code, "if", "return", "else:") & has_ternary(code)),
        F.when(
            has(code, "temp_") | has(code, "tmp_") | has(code, "temporary_"), temp_sites
        ).otherwise(0),
        _flag(_all_in(code, "for", "+=") & has_concat_in_loop(code)),
        _flag(_all_in(code, "if", "in", "[") & code.rlike(jre(rules.DICT_GET))),
    )
    return _found(rules.PATTERN_ISSUES, counts)


def loop_issues(code: Column) -> Column:
    """Array of (issue, n_found) of the loop simplifier."""
    counts = (
        _flag(has(code, "range(len(") & code.rlike(jre(rules.RANGE_LEN))),
        _flag(_all_in(code, "for", ".append") & code.rlike(jre(rules.NESTED_APPEND_SEARCH))),
        _flag(
            _all_in(code, "while", "break") & code.rlike(jre(rules.INFINITE_LOOP, dotall=True))
        ),
        _flag(_all_in(code, "for", "if") & has_filter_loop(code)),
        _flag(_all_in(code, "for", ".append(") & code.rlike(jre(rules.MAP_LOOP_SEARCH))),
        _flag(_all_in(code, "count", "+=") & code.rlike(jre(rules.MANUAL_COUNT, dotall=True))),
        _flag(_all_in(code, "sum", "+=") & code.rlike(jre(rules.MANUAL_SUM, dotall=True))),
        _flag(loop_count(code) > 3),
    )
    return _found(rules.LOOP_ISSUES, counts)


def _found(names: tuple[str, ...], counts: tuple[Column, ...]) -> Column:
    issues = [_issue(name, n) for name, n in zip(names, counts)]
    return F.filter(F.array(*issues), lambda x: x["n_found"] > 0)


def _with_lines(files: DataFrame) -> DataFrame:
    return files.select("file_id", "code", split_lines(F.col("code")).alias("lines"))


def detect_pattern_issues(files: DataFrame) -> DataFrame:
    found = pattern_issues(F.col("code"), F.col("lines"))
    return _with_lines(files).select("file_id", F.inline(found))


def detect_loop_issues(files: DataFrame) -> DataFrame:
    return files.select("file_id", F.inline(loop_issues(F.col("code"))))


def is_unsafe(code: Column) -> Column:
    """True when an edit would bring in a dangerous call."""
    return code.rlike(jre(rules.UNSAFE_CODE))


def findings_per_agent(files: DataFrame, *keep: str) -> DataFrame:
    """(file_id, keep, agent_id, issues_found, labels, confidence): one narrow pass for all agents.

    Confidence assumes that the text parses; ``audit.agent_analysis`` adds the syntax check.
    """
    lowered = _lowered(files, *keep).withColumn("lines", split_lines(F.col("code")))
    labelled = _hit("issue", lambda r: f"{r.category}:{r.pattern}")
    security = F.transform(labelled, lambda h: F.struct(h["issue"], h["n_matches"].alias("n_found")))
    found = lowered.select(
        "file_id",
        *keep,
        security.alias("security"),
        pattern_issues(F.col("code"), F.col("lines")).alias("pattern"),
        loop_issues(F.col("code")).alias("loop"),
    )

    def row(agent: str, issues: str, with_findings: float, without: float) -> Column:
        n = F.aggregate(issues, F.lit(0).cast("long"), lambda acc, x: acc + x["n_found"])
        labels = F.flatten(
            F.transform(issues, lambda x: F.array_repeat(x["issue"], x["n_found"].cast("int")))
        )
        return F.struct(
            F.lit(agent).alias("agent_id"),
            n.alias("issues_found"),
            labels.alias("labels"),
            F.when(F.size(issues) > 0, with_findings).otherwise(without).alias("confidence"),
        )

    rows = F.array(
        row("pattern_optimizer", "pattern", 0.8, 0.5),
        row("security_enforcer", "security", 0.9, 0.7),
        row("loop_simplifier", "loop", 0.8, 0.6),
    )
    return found.select("file_id", *keep, F.inline(rows))
