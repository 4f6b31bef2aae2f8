"""User extensions: a rule pack written as DataFrame functions, and rules that are plain data."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions.dialect import java_pattern, java_replacement
from corpusaudit.functions.literals import folded, grams_in, grams_of, grams_pattern, required_literals
from corpusaudit.functions.text import matches, rows_of, split_lines

PROPOSAL_SCHEMA = {
    "file_id": None,  # as in the corpus
    "agent_id": "string",
    "agent_ord": "int",
    "rule_id": "string",
    "rule_ord": "int",
    "change_type": "string",
    "original_code": "string",
    "modified_code": "string",
    "line_start": "int",
    "line_end": "int",
    "confidence": "double",
    "description": "string",
    "impact_score": "double",
}
RULE_COLUMNS = (
    "rule_id", "category", "pattern", "replacement", "confidence", "impact", "change_type"
)
# Rules whose index is sent to the executors at once.
RULES_AT_ONCE = 100_000


@dataclass(frozen=True)
class RulePack:
    """What a user agent provides. ``detect`` and ``propose`` map files to rows, ``vote`` scores an
    edit by its columns, ``validate`` judges (original_code, refactored_code)."""

    agent_id: str
    detect: Callable[[DataFrame], DataFrame]
    propose: Callable[[DataFrame], DataFrame]
    vote: Callable[[Callable[[str], Column]], Column]
    validate: Callable[[Column, Column], Column]


def check_proposals(proposed: DataFrame) -> DataFrame:
    """Refuses proposals whose columns or types differ from the schema that voting reads."""
    have = {f.name: f.dataType.simpleString() for f in proposed.schema.fields}
    wrong = [
        f"{name}: {have.get(name, 'missing')} instead of {kind}"
        for name, kind in PROPOSAL_SCHEMA.items()
        if name not in have or (kind is not None and have[name] != kind)
    ]
    if wrong:
        raise TypeError("rule pack does not fit: " + "; ".join(wrong))
    return proposed.select(*PROPOSAL_SCHEMA)


def propose_with(pack: RulePack, files: DataFrame) -> DataFrame:
    return check_proposals(pack.propose(files))


def validate_with(pack: RulePack, pairs: DataFrame) -> DataFrame:
    """The pack's verdict on (file_id, original_code, refactored_code)."""
    verdict = pack.validate(F.col("original_code"), F.col("refactored_code"))
    return pairs.select("file_id", verdict.alias("valid"))


def merge_rules(builtin: DataFrame, user: DataFrame) -> DataFrame:
    """Built-in rules and those user rules whose id is not taken."""
    free = user.join(builtin.select("rule_id"), "rule_id", "left_anti")
    return builtin.unionByName(free)


def _checked(rules: DataFrame) -> DataFrame:
    """Rule ids have to be present and unique, or a proposal could not be traced to its rule."""
    bad = rules.groupBy("rule_id").agg(F.count("*").alias("n")).filter("rule_id is null or n > 1")
    named = [str(r["rule_id"]) for r in bad.orderBy("rule_id").limit(10).collect()]
    if named:
        raise ValueError("rule ids are missing or not unique: " + ", ".join(named))
    if rules.isEmpty():
        raise ValueError("the rule table is empty")
    return rules


def literal_indexes(rules: DataFrame) -> Iterator[tuple[DataFrame, str]]:
    """The index of each ``RULES_AT_ONCE`` rules in the order of their ids: what is on the driver and sent
    to the executors at a time is bounded, and only larger tables read the corpus again."""
    rows, begin = rules.orderBy("rule_id").toLocalIterator(), 0
    while pack := list(islice(rows, RULES_AT_ONCE)):
        yield literal_index(rules, pack, begin)
        begin += len(pack)


def literal_index(rules: DataFrame, pack: list, begin: int) -> tuple[DataFrame, str]:
    """(gram, others, rule): where to look a rule up; and a pattern that finds these strings in a text. ``rule`` is a struct of the rule's columns with its
    place ``rule_ord``, its pattern and replacement for Java, and its required ``literals``.

    Each alternative of a rule is filed under the rarest of its three-character strings, counted over
    the rules, so that a string of a text leads to few rules. ``others`` lists the rule's strings
    before this one: a text that holds several leads to the rule by the first alone. Rules that
    require no literal are filed under the empty string.
    """
    spark = rules.sparkSession
    fields = list(rules.columns)
    prepared, files = [], []
    for i, r in enumerate(pack, begin):
        found = required_literals(r["pattern"])
        replacement = java_replacement(r["replacement"], r["pattern"]) if "replacement" in fields else ""
        prepared.append((*[r[f] for f in fields], i, java_pattern(r["pattern"]), replacement, found))
        files.append([grams_of(literal) for literal in found] or [[""]])
    uses = Counter(g for options in files for g in set().union(*options))
    entries = []
    for row, options in zip(prepared, files):
        own = sorted({min(grams, key=lambda g: (uses[g], g)) for grams in options})
        entries += [(g, own[:k], row) for k, g in enumerate(own)]
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rules.schema.fields)
    rule = f"struct<{kinds}, rule_ord: int, java_pattern: string, java_replacement: string, literals: array<string>>"
    index = spark.createDataFrame(entries, f"gram string, others array<string>, rule {rule}")
    return index, grams_pattern({g for g, _, _ in entries if g})


def candidates(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, code, low, rule): the rules whose literals a text holds, each once. Those strings of the text that
    the index holds are found in one pass and joined with it; only this decides which patterns run at all. The corpus is read once and
    the plan stays the same for up to ``RULES_AT_ONCE`` rules."""
    low = files.select("file_id", "code", folded(F.col("code")).alias("low"))

    def looked_up(pattern: str) -> DataFrame:
        grams = F.concat(F.array(F.lit("")), grams_in(F.col("low"), pattern))
        return low.select("file_id", "code", "low", F.explode(grams).alias("gram"))

    hits = reduce(DataFrame.unionByName, [looked_up(p).join(F.broadcast(x), "gram") for x, p in literal_indexes(_checked(rules))])
    first = F.forall("others", lambda g: ~F.contains(F.col("low"), g))
    return hits.filter(first & _holds(F.col("low"), F.col("rule"))).select("file_id", "code", "low", "rule")


def _holds(low: Column, rule: Column) -> Column:
    return (F.size(rule["literals"]) == 0) | F.exists(rule["literals"], lambda literal: F.contains(low, literal))


def scan_rule_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, rule_id, category, n_matches) of data-only rules, searched in whole texts."""
    found = candidates(files, rules.select("rule_id", "category", "pattern"))
    n = F.regexp_count("code", F.col("rule.java_pattern")).cast("long")
    row = F.struct(F.col("rule.rule_id").alias("rule_id"), F.col("rule.category").alias("category"), n.alias("n_matches"))
    return found.select("file_id", row.alias("hit")).select("file_id", rows_of(F.col("hit.n_matches") > 0, F.col("hit"))).select(
        "file_id", "rule_id", "category", "n_matches"
    )


def apply_rule_table(files: DataFrame, rules: DataFrame, agent_id: str, agent_ord: int) -> DataFrame:
    """Proposals of data-only rules: a line that matches ``pattern`` is rewritten by ``replacement``.

    Candidate rules come from the index; their patterns run on the lines that hold their literals.
    """
    rule = F.col("rule")
    # folding keeps line ends, so the lines of the folded text are the folded lines
    both = F.arrays_zip(split_lines(F.col("code")).alias("line"), split_lines(F.col("low")).alias("low"))
    numbered = F.transform(both, lambda x, i: F.struct(x["line"].alias("line"), x["low"].alias("low"), i.alias("line_no")))
    matching = F.filter(numbered, lambda x: _holds(x["low"], rule) & matches(x["line"], rule["java_pattern"]))
    found = F.transform(matching, lambda x: F.struct(x["line"].alias("line"), x["line_no"].alias("line_no")))
    hits = candidates(files, rules.select(*RULE_COLUMNS)).select("file_id", "rule", F.inline(found))
    return check_proposals(
        hits.select(
            "file_id",
            F.lit(agent_id).alias("agent_id"),
            F.lit(agent_ord).alias("agent_ord"),
            rule["rule_id"].alias("rule_id"),
            rule["rule_ord"].alias("rule_ord"),
            rule["change_type"].alias("change_type"),
            F.col("line").alias("original_code"),
            F.regexp_replace("line", rule["java_pattern"], rule["java_replacement"]).alias("modified_code"),
            F.col("line_no").alias("line_start"),
            F.col("line_no").alias("line_end"),
            rule["confidence"].cast("double").alias("confidence"),
            rule["category"].alias("description"),
            rule["impact"].cast("double").alias("impact_score"),
        )
    )
