"""One round on one file: flag edits, choose the best, apply it. Each function takes and returns
columns of one row (the file), so a round shuffles nothing; the DataFrame forms are below."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.config import AGENTS, AuditConfig
from corpusaudit.functions.text import indent_of, let, py_strip, rows_of, split_lines
from corpusaudit.operators.consensus import DIGITS, decide
from corpusaudit.operators.propose import PROPOSAL_FIELDS, Site, line_edits, with_lines
from corpusaudit.operators.useragents import UserAgent, active_rules, user_edits, voters_of


def flagged_edits(
    lines: Column, indents: Column, cfg: AuditConfig, user_rules: Column | None = None
) -> Column:
    """A file's edits, those of ``user_rules`` among them, with two flags: ``meaningful`` when the edit would change its line, and
    ``counted`` when it is the last meaningful edit with its vote key. Edits that share a key lie
    on one line, so the flag is settled within the few edits of that line."""

    def flag(edit: Column, current: Column) -> Column:
        return F.struct(
            *[edit[f].alias(f) for f in PROPOSAL_FIELDS],
            (py_strip(edit["modified_code"]) != py_strip(current)).alias("meaningful"),
        )

    def count_last(edits: Column) -> Column:
        def beaten(edit: Column) -> Column:
            return F.exists(
                edits,
                lambda other: other["meaningful"]
                & (other["agent_ord"] == edit["agent_ord"])
                & (other["change_type"] == edit["change_type"])
                & (other["rule_ord"] > edit["rule_ord"]),
            )

        return F.transform(
            edits,
            lambda e: F.struct(
                *[e[f].alias(f) for f in (*PROPOSAL_FIELDS, "meaningful")],
                (e["meaningful"] & ~beaten(e)).alias("counted"),
            ),
        )

    def per_line(line: Column, i: Column, active: Column | None) -> Column:
        found = line_edits(Site(lines, indents, line, i), cfg.agent_set)
        if active is not None:
            found = F.concat(found, user_edits(active, line, i))
        return let(F.transform(found, lambda e: flag(e, line)), count_last)

    def of_all(active: Column | None) -> Column:
        return F.flatten(F.transform(lines, lambda line, i: per_line(line, i, active)))

    return of_all(None) if user_rules is None else let(active_rules(user_rules, lines), of_all)


def best_edit(edits: Column) -> Column:
    """The meaningful edit with the highest confidence; of equals the first one emitted."""
    ranked = F.transform(
        F.filter(edits, lambda e: e["meaningful"]),
        lambda e: F.struct(
            (-e["confidence"]).alias("worst"),
            e["agent_ord"].alias("agent_ord"),
            e["line_start"].alias("line_start"),
            e["rule_ord"].alias("rule_ord"),
            e.alias("edit"),
        ),
    )
    return F.array_min(ranked)["edit"]


def round_decision(edits: Column, cfg: AuditConfig, agents: Sequence[UserAgent] = ()) -> Column:
    counted = F.filter(edits, lambda e: e["counted"])
    voting = (*cfg.agent_set, *[a.agent_id for a in agents])
    return decide(counted, voting, cfg.consensus_threshold, voters=voters_of(agents))


def passes_gate(best: Column, decision: Column, cfg: AuditConfig) -> Column:
    sure = best["confidence"] >= cfg.consensus_threshold
    return sure & (decision["decision"] == "accept_changes") if cfg.gate == "consensus" else sure


def _span(best: Column, cfg: AuditConfig) -> Column:
    return best["line_end"] - best["line_start"] + 1 if cfg.multi_line else F.lit(1)


def matches_text(lines: Column, best: Column, cfg: AuditConfig) -> Column:
    """True when the text still holds the code that the edit expects."""
    current = F.array_join(F.slice(lines, best["line_start"] + 1, _span(best, cfg)), "\n")
    return py_strip(current) == py_strip(best["original_code"])


def _new_lines(lines: Column, best: Column, cfg: AuditConfig) -> Column:
    fresh = split_lines(best["modified_code"])
    if not cfg.keep_indent:
        return fresh
    old = F.get(lines, best["line_start"])
    margin = F.substring(old, F.lit(1), indent_of(old))
    return F.transform(
        fresh, lambda line: F.when(indent_of(line) == 0, F.concat(margin, line)).otherwise(line)
    )


def apply_edit(lines: Column, best: Column, cfg: AuditConfig) -> Column:
    """The lines with the edit put in; line breaks in the new code make new lines."""
    start = best["line_start"]
    return F.concat(
        F.slice(lines, F.lit(1), start),
        _new_lines(lines, best, cfg),
        F.slice(lines, start + _span(best, cfg) + 1, F.size(lines)),
    )


def moved_origin(origin: Column, best: Column, cfg: AuditConfig) -> Column:
    """The original numbers of the lines after the edit; lines that it brings in have -1."""
    start = best["line_start"]
    return F.concat(
        F.slice(origin, F.lit(1), start),
        F.transform(split_lines(best["modified_code"]), lambda _: F.lit(-1)),
        F.slice(origin, start + _span(best, cfg) + 1, F.size(origin)),
    )


def with_round(files: DataFrame, cfg: AuditConfig, *keep: str) -> DataFrame:
    """(file_id, lines, edits, best, decision) of one round over the corpus."""
    flagged = with_lines(files, *keep).select(
        "file_id",
        *keep,
        "lines",
        flagged_edits(F.col("lines"), F.col("indents"), cfg).alias("edits"),
    )
    return flagged.select(
        "file_id",
        *keep,
        "lines",
        "edits",
        best_edit(F.col("edits")).alias("best"),
        round_decision(F.col("edits"), cfg).alias("decision"),
    )


def file_decisions(
    files: DataFrame,
    threshold: float = 0.6,
    agent_set: Sequence[str] = AGENTS,
    weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """``consensus.consensus`` over a file's own proposals, settled in its row: no vote is shuffled. Edits with
    the same vote key lie on one line, and the last of them counts."""

    def counted(line: Column, i: Column) -> Column:
        def last(edits: Column) -> Column:
            return F.filter(
                edits,
                lambda e: ~F.exists(
                    edits,
                    lambda other: (other["agent_ord"] == e["agent_ord"])
                    & (other["change_type"] == e["change_type"])
                    & (other["rule_ord"] > e["rule_ord"]),
                ),
            )

        return let(line_edits(Site(F.col("lines"), F.col("indents"), line, i), agent_set), last)

    edits = F.flatten(F.transform("lines", counted))
    decided = with_lines(files).select("file_id", decide(edits, agent_set, threshold, weights).alias("d"))
    return decided.select("file_id", "d.*")


def meaningful_changes(files: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """Proposals that would change their line."""
    edits = with_lines(files).select(
        "file_id", F.inline(flagged_edits(F.col("lines"), F.col("indents"), cfg))
    )
    return edits.filter("meaningful").select("file_id", *PROPOSAL_FIELDS)


def best_change(files: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    edits = with_lines(files).select(
        "file_id", flagged_edits(F.col("lines"), F.col("indents"), cfg).alias("edits")
    )
    best = best_edit(F.col("edits"))
    rows = edits.select("file_id", F.inline(F.array_compact(F.array(best))))
    return rows.select("file_id", *PROPOSAL_FIELDS)


def gated_change(files: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """Best edits that pass the gate, with the decision of the vote beside them."""
    best, decision = F.col("best"), F.col("decision")
    row = F.struct(
        best["rule_id"].alias("rule_id"),
        best["line_start"].alias("line_start"),
        best["confidence"].alias("confidence"),
        decision["decision"].alias("decision"),
        decision["winning_agent"].alias("winning_agent"),
        decision["confidence"].alias("vote_confidence"),
    )
    return with_round(files, cfg).select("file_id", rows_of(passes_gate(best, decision, cfg), row))


def apply_best(files: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """(file_id, original_code, refactored_code, applied): every file after one round."""
    lines, best = F.col("lines"), F.col("best")
    applies = passes_gate(best, F.col("decision"), cfg) & matches_text(lines, best, cfg)
    result = F.when(
        applies,
        F.struct(F.array_join(apply_edit(lines, best, cfg), "\n"), F.lit(True)),
    ).otherwise(F.struct(F.array_join(lines, "\n"), F.lit(False)))
    typed = result.cast("struct<refactored_code:string,applied:boolean>")
    return with_round(files, cfg, "code").select(
        "file_id", F.col("code").alias("original_code"), F.inline(F.array(typed))
    )


def apply_mismatch(files: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """Best edits that pass the gate but expect other text than the file holds."""
    lines, best = F.col("lines"), F.col("best")
    blocked = passes_gate(best, F.col("decision"), cfg) & ~matches_text(lines, best, cfg)
    row = F.struct(
        best["rule_id"].alias("rule_id"),
        best["line_start"].alias("line_start"),
        py_strip(best["original_code"]).alias("expected"),
        py_strip(F.get(lines, best["line_start"])).alias("found"),
    )
    return with_round(files, cfg).select("file_id", rows_of(blocked, row))
