"""Edit proposals. Every rule is an expression over a line and the lines after it, evaluated where
the file lies: proposing is one narrow pass over the corpus, whatever the number of rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.config import AGENTS
from corpusaudit.functions.text import (
    block_end,
    block_indents,
    first_index,
    has,
    jre,
    let,
    py_strip,
    split_lines,
)
from corpusaudit.operators.lines import WHILE_TRUE, is_nested_loop

PROPOSAL_FIELDS = (
    "agent_id",
    "agent_ord",
    "rule_id",
    "rule_ord",
    "change_type",
    "original_code",
    "modified_code",
    "line_start",
    "line_end",
    "confidence",
    "description",
    "impact_score",
)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    agent_id: str
    change_type: str
    confidence: float
    impact_score: float
    description: str


# Agent, kind, confidence, impact and wording of the seventeen edits.
RULES = {
    r.rule_id: r
    for r in (
        Rule("D1", "security_enforcer", "security", 0.9, 0.9,
             "Replace string formatting with parameterized queries"),
        Rule("D2", "security_enforcer", "security", 0.8, 0.8,
             "Move hardcoded password to environment variable"),
        Rule("D3", "security_enforcer", "security", 0.8, 0.8,
             "Move hardcoded API key to environment variable"),
        Rule("D4", "security_enforcer", "security", 0.95, 0.95,
             "Remove dangerous eval()/exec() with user input"),
        Rule("D5", "security_enforcer", "security", 0.8, 0.7,
             "Replace weak hash algorithm with SHA-256"),
        Rule("D6", "security_enforcer", "security", 0.85, 0.8,
             "Add path validation to prevent directory traversal"),
        Rule("D7", "security_enforcer", "security", 0.7, 0.6,
             "Use cryptographically secure random for security purposes"),
        Rule("D8", "security_enforcer", "security", 0.9, 0.85,
             "Replace os.system() with safer subprocess call"),
        Rule("D9", "pattern_optimizer", "optimization", 0.7, 0.6, "Convert to list comprehension"),
        Rule("D10", "pattern_optimizer", "optimization", 0.8, 0.5, "Convert to ternary operator"),
        Rule("D11", "pattern_optimizer", "performance", 0.6, 0.7,
             "Use join() instead of string concatenation in loop"),
        Rule("D12", "pattern_optimizer", "optimization", 0.9, 0.4,
             "Use dict.get() instead of key checking"),
        Rule("D13", "loop_simplifier", "optimization", 0.9, 0.6,
             "Replace range(len()) with enumerate()"),
        Rule("D14", "loop_simplifier", "optimization", 0.8, 0.7,
             "Convert filter loop to list comprehension"),
        Rule("D15", "loop_simplifier", "performance", 0.9, 0.8,
             "Replace manual sum with built-in sum()"),
        Rule("D16", "loop_simplifier", "optimization", 0.6, 0.5,
             "Consider refactoring while True loop"),
        Rule("D17", "loop_simplifier", "performance", 0.7, 0.7, "Optimize nested loop structure"),
    )
}

# Comment lines that replace or precede code.
EVAL_COMMENT = (
    "# SECURITY: eval()/exec() with user input removed - use ast.literal_eval() for safe evaluation"
)
PATH_COMMENT = "# SECURITY: Path traversal detected - validate and sanitize path"
SYSTEM_COMMENT = "# SECURITY: Use subprocess with shell=False instead of os.system()"
JOIN_COMMENT = "# Consider using join() instead of string concatenation"
WHILE_COMMENT = "# Consider refactoring infinite loop"
NESTED_COMMENT = "# Consider nested comprehension:"

# Line patterns of the edits.
ASSIGNED = jre(r"(\w+)\s*=")
PASSWORD = jre(r"""password\s*=\s*["'][^"']{8,}["']""")
API_KEY = jre(r"""api_key\s*=\s*["'][A-Za-z0-9+/=]{16,}["']""")
SQL_FORMAT = jre(r"cursor\.execute\([^)]*%")
PLACEHOLDER = jre(r"%s|%d|%\w+")
TRAVERSAL = jre(r"""["'][^"']*\.\./[^"']*["']""")
SYSTEM_CONCAT = jre(r"os\.system\([^)]*\+")
FOR_ANY = jre(r"for\s+(\w+)\s+in\s+(.+):")
FOR_NAME = jre(r"for\s+(\w+)\s+in\s+(\w+):")
FOR_COLON = jre(r"for\s+.+:")
APPEND = jre(r"(\w+)\.append\((.+)\)")
IF_COLON = jre(r"if\s+(.+):")
IF_SPACE = jre(r"if\s+")
IF_IN = jre(r"^\s*if\s+(\w+)\s+in\s+(\w+):")
RETURN = jre(r"return\s+(.+)")
ADD_TO = jre(r"\w+\s*\+=\s*")
RANGE_LEN = jre(r"for\s+(\w+)\s+in\s+range\(len\((\w+)\)\)")
ZERO = jre(r"(\w+)\s*=\s*0")


@dataclass(frozen=True)
class Site:
    """A line with its surroundings inside the file."""

    lines: Column
    indents: Column
    line: Column
    index: Column

    def after(self, k: int) -> Column:
        return F.get(self.lines, self.index + k)

    def block(self, k: int) -> Column:
        """The line and the k lines after it."""
        return F.concat_ws("\n", self.line, *[self.after(j) for j in range(1, k + 1)])


def group(text: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(text, pattern, k)


def _edit(
    rule_id: str, agent_ord: int, site: Site, original: Column, modified: Column, span: Column | int
) -> Column:
    rule = RULES[rule_id]
    end = site.index + span if isinstance(span, int) else span
    return F.struct(
        F.lit(rule.agent_id).alias("agent_id"),
        F.lit(agent_ord).alias("agent_ord"),
        F.lit(rule_id).alias("rule_id"),
        F.lit(int(rule_id[1:])).alias("rule_ord"),
        F.lit(rule.change_type).alias("change_type"),
        original.alias("original_code"),
        modified.alias("modified_code"),
        site.index.cast("int").alias("line_start"),
        end.cast("int").alias("line_end"),
        F.lit(rule.confidence).alias("confidence"),
        F.lit(rule.description).alias("description"),
        F.lit(rule.impact_score).alias("impact_score"),
    )


def security_edits(site: Site, agent_ord: int) -> list[Column]:
    """D1-D8: independent rules on single lines; several may hold on one line."""
    line = site.line

    def edit(rule_id: str, when: Column, modified: Column) -> Column:
        return F.when(when, _edit(rule_id, agent_ord, site, line, modified, 0))

    def from_environment(name: str) -> Column:
        return F.concat(group(line, ASSIGNED, 1), F.lit(f' = os.environ.get("{name}")'))

    lowered = F.lower(line)
    return [
        edit("D1", has(line, "cursor.execute(") & line.rlike(SQL_FORMAT) & ~has(line, "?"),
             F.regexp_replace(line, PLACEHOLDER, "?")),
        edit("D2", has(line, "password") & line.rlike(PASSWORD)
             & ~has(line, "os.environ") & ~has(line, "getpass"), from_environment("PASSWORD")),
        edit("D3", has(line, "api_key") & line.rlike(API_KEY) & ~has(line, "os.environ"),
             from_environment("API_KEY")),
        # "raw_input(" contains "input(", so one check covers both.
        edit("D4", (has(line, "eval(") | has(line, "exec(")) & has(line, "input("),
             F.lit(EVAL_COMMENT)),
        edit("D5", has(line, "hashlib.md5(") | has(line, "hashlib.sha1("),
             F.regexp_replace(line, r"hashlib\.(?:md5|sha1)\(", "hashlib.sha256(")),
        edit("D6", has(line, "../") & line.rlike(TRAVERSAL),
             F.concat(F.lit(PATH_COMMENT + "\n"), line)),
        edit("D7", has(line, "random.random(")
             & (has(lowered, "password") | has(lowered, "token") | has(lowered, "secret")),
             F.replace(line, F.lit("random.random()"), F.lit("secrets.SystemRandom().random()"))),
        edit("D8", has(line, "os.system(") & line.rlike(SYSTEM_CONCAT), F.lit(SYSTEM_COMMENT)),
    ]


def pattern_edits(site: Site, agent_ord: int) -> list[Column]:
    """D9-D12: independent rules that look up to three lines ahead."""
    line, next1, next2 = site.line, site.after(1), site.after(2)
    next3 = F.coalesce(site.after(3), F.lit(""))

    item = group(line, FOR_ANY, 1)
    iterable = group(line, FOR_ANY, 2)
    target = group(py_strip(next1), APPEND, 1)
    appended = group(py_strip(next1), APPEND, 2)
    comprehension = F.when(
        py_strip(appended) == item, F.concat(target, F.lit(" = list("), iterable, F.lit(")"))
    ).otherwise(
        F.concat(target, F.lit(" = ["), appended, F.lit(" for "), item, F.lit(" in "), iterable,
                 F.lit("]"))
    )
    list_site = (
        has(line, "for") & has(next1, ".append(") & ~F.startswith(py_strip(line), F.lit("#"))
        & line.rlike(FOR_ANY) & py_strip(next1).rlike(APPEND)
    )

    ternary = F.concat(
        F.lit("return "), group(py_strip(next1), RETURN, 1),
        F.lit(" if "), group(line, IF_COLON, 1),
        F.lit(" else "), group(py_strip(next3), RETURN, 1),
    )
    ternary_site = (
        has(line, "if") & has(next1, "return") & has(next2, "else:") & line.rlike(IF_COLON)
        & py_strip(next1).rlike(RETURN) & py_strip(next3).rlike(RETURN)
    )

    key, name = group(line, IF_IN, 1), group(line, IF_IN, 2)
    looked_up = F.concat(name, F.lit("["), key, F.lit("]"))
    got = F.concat(name, F.lit(".get("), key, F.lit(")"))

    joined = site.block(1)
    return [
        F.when(list_site, _edit("D9", agent_ord, site, joined, comprehension, 1)),
        F.when(
            ternary_site,
            _edit("D10", agent_ord, site,
                  py_strip(F.concat_ws("\n", line, next1, next2, next3)), ternary, 3),
        ),
        F.when(
            has(line, "for") & has(next1, "+=") & line.rlike(FOR_COLON) & next1.rlike(ADD_TO),
            _edit("D11", agent_ord, site, joined, F.concat(F.lit(JOIN_COMMENT + "\n"), joined), 1),
        ),
        F.when(
            has(line, "if") & has(next1, "[") & line.rlike(IF_IN) & F.contains(next1, looked_up),
            _edit("D12", agent_ord, site, joined, F.replace(next1, looked_up, got), 1),
        ),
    ]


def loop_edit(site: Site, agent_ord: int) -> Column:
    """D13-D17: the first rule whose head holds takes the line, even if it then proposes nothing."""
    line, next1, next2 = site.line, site.after(1), site.after(2)
    bare = py_strip(line)

    i_name, xs = group(line, RANGE_LEN, 1), group(line, RANGE_LEN, 2)
    enumerated = F.replace(
        bare,
        F.concat(F.lit("for "), i_name, F.lit(" in range(len("), xs, F.lit("))")),
        F.concat(F.lit("for "), i_name, F.lit(", item in enumerate("), xs, F.lit(")")),
    )

    body = py_strip(next2)
    kept = F.concat(
        py_strip(F.substring_index(body, ".append", 1)), F.lit(" = [item for item in "),
        group(line, FOR_NAME, 2), F.lit(" if "), group(next1, IF_COLON, 1), F.lit("]"),
    )
    appends_item = F.concat(F.lit(".append("), group(line, FOR_NAME, 1), F.lit(")"))
    block3 = F.concat_ws("\n", bare, next1, next2)

    total = group(line, ZERO, 1)
    adds_item = F.concat(total, F.lit(" += "), group(next1, FOR_NAME, 1))
    summed = F.concat(total, F.lit(" = sum("), group(next1, FOR_NAME, 2), F.lit(")"))

    return (
        F.when(
            has(line, "range(len(") & line.rlike(RANGE_LEN),
            _edit("D13", agent_ord, site, bare, enumerated, 0),
        )
        .when(
            has(line, "for") & has(next1, "if") & line.rlike(FOR_NAME) & next1.rlike(IF_SPACE),
            F.when(
                next1.rlike(IF_COLON) & F.endswith(body, appends_item),
                _edit("D14", agent_ord, site, block3, kept, 2),
            ),
        )
        .when(
            has(line, "0") & has(next1, "for ") & line.rlike(ZERO),
            F.when(
                next1.rlike(FOR_NAME) & (body == adds_item),
                _edit("D15", agent_ord, site, block3, summed, 2),
            ),
        )
        .when(has(line, "while") & line.rlike(WHILE_TRUE), _block_edit(site, agent_ord, _endless))
        .when(
            is_nested_loop(site.lines, site.indents, line, site.index),
            _block_edit(site, agent_ord, _nested),
        )
    )


def _block_edit(site: Site, agent_ord: int, build) -> Column:
    """An edit of the indented block opened by the line, when it has a body."""

    def with_end(end: Column) -> Column:
        block = F.slice(site.lines, (site.index + 1).cast("int"), end - site.index + 1)
        return F.when(end > site.index, let(block, lambda b: build(site, agent_ord, b, end)))

    return let(block_end(site.indents, site.index), with_end)


def _endless(site: Site, agent_ord: int, block: Column, end: Column) -> Column:
    text = F.array_join(block, "\n")
    return F.when(
        F.exists(block, lambda line: has(line, "break")),
        _edit("D16", agent_ord, site, text, F.concat(F.lit(WHILE_COMMENT + "\n"), text), end),
    )


def _nested(site: Site, agent_ord: int, block: Column, end: Column) -> Column:
    """The block under the comprehension it could become: its own loop, the first loop inside and
    the first append after that."""
    outer = F.get(block, F.lit(0))
    inner_at = 1 + first_index(
        F.slice(block, 2, F.size(block)), lambda line: has(line, "for") & line.rlike(FOR_NAME)
    )

    def with_inner(at: Column) -> Column:
        rest = F.slice(block, at + 2, F.size(block))
        appends = first_index(rest, lambda line: has(line, ".append(") & line.rlike(APPEND))

        def with_append(offset: Column) -> Column:
            inner, append = F.get(block, at), F.get(rest, offset)
            text = F.array_join(block, "\n")
            suggestion = F.concat(
                F.lit(NESTED_COMMENT + "\n# "), group(append, APPEND, 1), F.lit(" = ["),
                group(append, APPEND, 2),
                F.lit(" for "), group(outer, FOR_NAME, 1), F.lit(" in "), group(outer, FOR_NAME, 2),
                F.lit(" for "), group(inner, FOR_NAME, 1), F.lit(" in "), group(inner, FOR_NAME, 2),
                F.lit("]\n"), text,
            )
            return F.when(
                offset.isNotNull(), _edit("D17", agent_ord, site, text, suggestion, end)
            )

        return F.when(at.isNotNull(), let(appends, with_append))

    return F.when(
        (F.size(block) >= 3) & outer.rlike(FOR_NAME), let(inner_at, with_inner)
    )


def line_edits(site: Site, agent_set: Sequence[str]) -> Column:
    """All edits proposed for one line. Each group of rules is tried only on lines that hold what
    all of its rules need, so most lines cost a handful of literal checks."""
    line = site.line
    groups: list[Column] = []
    for agent_ord, agent in enumerate(agent_set):
        if agent == "security_enforcer":
            gate = has(line, "(") | has(line, "=") | has(line, "../")
            groups.append(F.when(gate, F.array(*security_edits(site, agent_ord))))
        elif agent == "pattern_optimizer":
            listed, ternary, joined, keyed = pattern_edits(site, agent_ord)
            groups.append(F.when(has(line, "for"), F.array(listed, joined)))
            groups.append(F.when(has(line, "if"), F.array(ternary, keyed)))
        elif agent == "loop_simplifier":
            gate = has(line, "for") | has(line, "0") | has(line, "while")
            groups.append(F.when(gate, F.array(loop_edit(site, agent_ord))))
        else:
            raise ValueError(f"AGENT_NOT_FOUND: {agent}")
    return F.array_compact(F.flatten(F.array_compact(F.array(*groups))))


def edits_by_line(lines: Column, indents: Column, agent_set: Sequence[str] = AGENTS) -> Column:
    """array (one item per line) of arrays of edits."""
    return F.transform(lines, lambda line, i: line_edits(Site(lines, indents, line, i), agent_set))


def with_lines(files: DataFrame, *keep: str) -> DataFrame:
    """Adds the arrays that the edits read: the lines and their indents."""
    lines = files.select("file_id", *keep, split_lines(F.col("code")).alias("lines"))
    return lines.select(
        "file_id", *keep, "lines", block_indents(F.col("lines")).alias("indents")
    )


def proposals(files: DataFrame, agent_set: Sequence[str] = AGENTS) -> DataFrame:
    """One row per proposed edit. (agent_ord, line_start, rule_ord) is the order of emission."""
    edits = edits_by_line(F.col("lines"), F.col("indents"), agent_set)
    return with_lines(files).select("file_id", F.inline(F.flatten(edits)))


def proposals_by_type(proposed: DataFrame) -> DataFrame:
    return proposed.groupBy("agent_id", "change_type", "rule_id").agg(
        F.count("*").alias("n_proposals"), F.sum("impact_score").alias("impact")
    )
