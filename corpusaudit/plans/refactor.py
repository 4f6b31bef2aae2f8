"""Refactor a corpus to its fix-point in one narrow pass.

A round needs nothing but the file itself, so the rounds are folded inside the row: the corpus is
read once and written once, however many rounds a file takes, and no round needs a shuffle, a
checkpoint or a driver loop. Files close on their own: a closed file costs nothing in later rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.config import AuditConfig
from corpusaudit.functions.text import block_indents, let, split_lines
from corpusaudit.operators.apply import (
    apply_edit,
    best_edit,
    flagged_edits,
    matches_text,
    moved_origin,
    passes_gate,
    round_decision,
)
from corpusaudit.operators.script import lines_changed
from corpusaudit.operators.useragents import UserAgent, checked, rules_array

STEP = (
    "struct<iteration:int,agent:string,change_type:string,confidence:double,description:string,"
    "line_start:int,line_end:int,original_code:string,modified_code:string>"
)
DECISION = "struct<iteration:int,decision:string,winning_agent:string,confidence:double>"
# Rounds without a meaningful edit after which a file is closed.
MAX_STALLS = 3


def _state(lines, origin, stalls, reason, rounds, steps, decisions) -> Column:
    return F.struct(
        lines.alias("lines"),
        origin.cast("array<int>").alias("origin"),
        stalls.cast("int").alias("stalls"),
        reason.cast("string").alias("reason"),
        rounds.cast("int").alias("rounds"),
        steps.cast(f"array<{STEP}>").alias("steps"),
        decisions.cast(f"array<{DECISION}>").alias("decisions"),
    )


def _step(best: Column, i: Column) -> Column:
    return F.struct(
        i,
        best["agent_id"],
        best["change_type"],
        best["confidence"],
        best["description"],
        best["line_start"],
        best["line_end"],
        best["original_code"],
        best["modified_code"],
    ).cast(STEP)


def _logged(decision: Column, i: Column) -> Column:
    return F.struct(
        i, decision["decision"], decision["winning_agent"], decision["confidence"]
    ).cast(DECISION)


def _round(
    state: Column, i: Column, cfg: AuditConfig, agents: Sequence[UserAgent], rules: Column | None
) -> Column:
    """The state after round ``i`` of an open file."""
    lines, last = state["lines"], cfg.max_iterations - 1

    def keep(stalls: Column, reason: Column, rounds: Column, decisions: Column) -> Column:
        return _state(lines, state["origin"], stalls, reason, rounds, state["steps"], decisions)

    def stalled() -> Column:
        # The text stays as it is, so the following rounds find nothing either.
        rounds = F.least(i + MAX_STALLS - state["stalls"], F.lit(cfg.max_iterations))
        reason = F.when(i + MAX_STALLS - state["stalls"] <= cfg.max_iterations, "stalled")
        return keep(
            F.lit(MAX_STALLS),
            F.coalesce(reason, F.lit("max_iterations")),
            rounds,
            state["decisions"],
        )

    def voted(best: Column, decision: Column) -> Column:
        moved = _state(
            apply_edit(lines, best, cfg),
            moved_origin(state["origin"], best, cfg),
            F.lit(0),
            F.lit(None),
            i + 1,
            F.concat(state["steps"], F.array(_step(best, i))),
            F.concat(state["decisions"], F.array(_logged(decision, i))),
        )
        # A best edit that cannot be applied stays the best one: every round up to the limit
        # repeats this vote, or the file is closed at once.
        if cfg.early_stop:
            entries = F.array(_logged(decision, i))
            reason, rounds = F.lit("blocked"), i + 1
        else:
            entries = F.transform(F.sequence(i, F.lit(last)), lambda k: _logged(decision, k))
            reason, rounds = F.lit("max_iterations"), F.lit(cfg.max_iterations)
        blocked = keep(F.lit(1), reason, rounds, F.concat(state["decisions"], entries))
        applies = passes_gate(best, decision, cfg) & matches_text(lines, best, cfg)
        return F.when(applies, moved).otherwise(blocked)

    def with_edits(edits: Column) -> Column:
        return F.when(
            F.size(edits) == 0,
            keep(state["stalls"], F.lit("no_changes"), i + 1, state["decisions"]),
        ).otherwise(
            let(
                F.struct(best_edit(edits).alias("best"), round_decision(edits, cfg, agents).alias("vote")),
                lambda r: F.when(r["best"].isNull(), stalled()).otherwise(
                    voted(r["best"], r["vote"])
                ),
            )
        )

    return let(
        block_indents(lines),
        lambda indents: let(flagged_edits(lines, indents, cfg, rules), with_edits),
    )


def refactor(
    files: DataFrame, cfg: AuditConfig = AuditConfig(), agents: Sequence[UserAgent] = ()
) -> DataFrame:
    """The corpus refactored by the built-in agents and the user's: all propose and vote in every round, in
    that order.

    (file_id, path, original_code, refactored_code, reason, rounds, steps, decisions, lines_changed).

    A file has at most ``max_iterations`` steps and decisions, so both arrays stay small. The fold also
    carries the original number of every line that is still there; from it the changed lines are
    counted in order, without comparing the texts.
    """
    agents = checked(agents, cfg.agent_set)
    rules = rules_array(agents, len(cfg.agent_set)) if agents else None
    rounds = F.sequence(F.lit(0), F.lit(cfg.max_iterations - 1))
    lines = split_lines(F.col("code"))
    numbers = F.transform(lines, lambda _, i: i)
    start = _state(lines, numbers, F.lit(0), F.lit(None), F.lit(0), F.array(), F.array())

    def advance(state: Column, i: Column) -> Column:
        return F.when(state["reason"].isNotNull(), state).otherwise(
            _round(state, i, cfg, agents, rules)
        )

    run = files.select(
        "file_id", "path", "code", F.aggregate(rounds, start, advance).alias("state")
    )
    return run.select(
        "file_id",
        "path",
        F.col("code").alias("original_code"),
        F.array_join("state.lines", "\n").alias("refactored_code"),
        F.coalesce("state.reason", F.lit("max_iterations")).alias("reason"),
        F.col("state.rounds").alias("rounds"),
        F.col("state.steps").alias("steps"),
        F.col("state.decisions").alias("decisions"),
        F.when(F.col("code").isNull(), "unreadable text").alias("error_message"),
        lines_changed(lines, F.col("state.lines"), F.col("state.origin")).alias("lines_changed"),
    )
