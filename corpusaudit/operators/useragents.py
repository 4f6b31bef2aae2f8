"""User agents inside the fix-point: rules that are data, and a voter, evaluated where the file lies.

The rules of all agents are one array beside the file's lines. In each round those whose literals the text
holds are picked first, so a text that no user rule concerns costs a few comparisons.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.config import AGENTS
from corpusaudit.functions.dialect import java_pattern, java_replacement
from corpusaudit.functions.literals import folded, required_literals
from corpusaudit.functions.text import let, matches
from corpusaudit.operators.rulepack import RULE_COLUMNS
from corpusaudit.operators.vote import Field, Voters

# Rules of all agents together: they travel with every row of the loop. Larger tables propose outside it
# (``rulepack.apply_rule_table``).
MOST_RULES = 2000


@dataclass(frozen=True)
class UserAgent:
    """Rules (rows of ``RULE_COLUMNS``) that rewrite matching lines, and a voter that scores any edit by its
    columns."""

    agent_id: str
    rules: tuple[tuple, ...]
    vote: Callable[[Field], Column]

    @staticmethod
    def from_table(agent_id: str, rules: DataFrame, vote: Callable[[Field], Column]) -> UserAgent:
        found = rules.select(*RULE_COLUMNS).orderBy("rule_id").limit(MOST_RULES + 1).collect()
        return UserAgent(agent_id, tuple(tuple(r) for r in found), vote)


def checked(agents: Sequence[UserAgent], agent_set: Sequence[str]) -> tuple[UserAgent, ...]:
    """Built-in ids cannot be taken, ids are unique, and the rules fit beside a row."""
    ids = [a.agent_id for a in agents]
    taken = sorted({i for i in ids if i in (*AGENTS, *agent_set) or ids.count(i) > 1})
    if taken:
        raise ValueError(f"agent ids are taken or not unique: {', '.join(taken)}")
    if sum(len(a.rules) for a in agents) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules in the loop")
    for a in agents:
        names = [r[0] for r in a.rules]
        if None in names or len(set(names)) < len(names):
            raise ValueError(f"{a.agent_id}: rule ids are missing or not unique")
    return tuple(agents)


def voters_of(agents: Sequence[UserAgent]) -> Voters:
    return {a.agent_id: a.vote for a in agents}


RULE = (
    "array<struct<agent_id:string,agent_ord:int,rule_id:string,rule_ord:int,change_type:string,pattern:string,"
    "replacement:string,confidence:double,description:string,impact_score:double,literals:array<string>>>"
)


def rules_array(agents: Sequence[UserAgent], first_ord: int) -> Column:
    rows = []
    for k, agent in enumerate(agents):
        for i, (rule_id, category, pattern, replacement, confidence, impact, kind) in enumerate(agent.rules):
            literals = [F.lit(x) for x in required_literals(pattern)]
            rows.append(
                F.struct(
                    F.lit(agent.agent_id), F.lit(first_ord + k), F.lit(rule_id), F.lit(i), F.lit(kind),
                    F.lit(java_pattern(pattern)), F.lit(java_replacement(replacement, pattern)),
                    F.lit(float(confidence)), F.lit(category), F.lit(float(impact)),
                    F.array(*literals).cast("array<string>"),
                )
            )
    return F.array(*rows).cast(RULE)


def _held(rules: Column, low: Column) -> Column:
    """The rules that require no literal, or one that the folded text holds."""
    return F.filter(
        rules,
        lambda r: (F.size(r["literals"]) == 0) | F.exists(r["literals"], lambda x: F.contains(low, x)),
    )


def active_rules(rules: Column, lines: Column) -> Column:
    """The rules that can match some line of a text, which is folded once for all of them."""
    return let(F.array_join(lines, "\n"), lambda text: let(folded(text), lambda low: _held(rules, low)))


def user_edits(active: Column, line: Column, index: Column) -> Column:
    """The edits that the active rules propose for one line, which is folded once for all of them and not at
    all if no rule is active."""
    held = F.when(F.size(active) > 0, let(folded(line), lambda low: _held(active, low))).otherwise(active)
    return F.transform(
        F.filter(held, lambda r: matches(line, r["pattern"])),
        lambda r: F.struct(
            r["agent_id"].alias("agent_id"),
            r["agent_ord"].alias("agent_ord"),
            r["rule_id"].alias("rule_id"),
            r["rule_ord"].alias("rule_ord"),
            r["change_type"].alias("change_type"),
            line.alias("original_code"),
            F.regexp_replace(line, r["pattern"], r["replacement"]).alias("modified_code"),
            index.cast("int").alias("line_start"),
            index.cast("int").alias("line_end"),
            r["confidence"].alias("confidence"),
            r["description"].alias("description"),
            r["impact_score"].alias("impact_score"),
        ),
    )
