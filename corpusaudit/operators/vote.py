"""Voting. A voter scores an edit with an expression, so all voters score in one narrow pass; no
join of voters and edits is needed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusaudit.config import AGENTS
from corpusaudit.operators.scan import is_unsafe

Field = Callable[[str], Column]
# A voter outside the built-in ones: maps the columns of an edit to its score.
Voters = Mapping[str, Callable[[Field], Column]]

# Words in a description that the loop simplifier favours.
LOOP_WORDS = r"loop|comprehension|enumerate|built-in"
# The score of a voter that failed, and of a vetoed edit.
NEUTRAL = 0.5
VETO = 0.1

EMITTED = ("agent_ord", "line_start", "rule_ord")


def _capped(score: Column) -> Column:
    return F.least(score, F.lit(1.0))


def score(voter: str, field: Field, voters: Voters | None = None) -> Column:
    """Score that ``voter`` gives to the edit whose columns ``field`` returns. Built-in voters win
    over those in ``voters``."""
    confidence, kind = field("confidence"), field("change_type")
    if voter == "security_enforcer":
        return (
            F.when(kind == "security", _capped(confidence * 1.5))
            .when(
                kind == "optimization",
                F.when(is_unsafe(field("modified_code")), VETO).otherwise(confidence * 0.9),
            )
            .otherwise(confidence * 0.7)
        )
    if voter == "pattern_optimizer":
        return (
            F.when(kind == "optimization", _capped(confidence * 1.2))
            .when(kind == "performance", _capped(confidence * 1.1))
            .when(kind == "security", confidence * 0.9)
            .otherwise(confidence * 0.8)
        )
    if voter == "loop_simplifier":
        return (
            F.when(F.lower(field("description")).rlike(LOOP_WORDS), _capped(confidence * 1.3))
            .when(kind == "performance", confidence * 1.1)
            .when(kind == "optimization", confidence * 1.0)
            .otherwise(confidence * 0.6)
        )
    if voters and voter in voters:
        return voters[voter](field)
    raise ValueError(f"AGENT_NOT_FOUND: {voter}")


def vote_key(field: Field) -> Column:
    return F.concat_ws(
        "_", field("agent_id"), field("line_start").cast("string"), field("change_type")
    )


def collect_votes(
    proposed: DataFrame,
    agent_set: Sequence[str] = AGENTS,
    failed: Sequence[str] = (),
    voters: Voters | None = None,
) -> DataFrame:
    """One row per voter and edit. A failed voter gives a neutral score to change_0, change_1, ..."""
    keyed = proposed.withColumn("vote_key", vote_key(F.col))
    if failed:
        place = F.row_number().over(W.partitionBy("file_id").orderBy(*EMITTED)) - 1
        keyed = keyed.withColumn("neutral_key", F.concat(F.lit("change_"), place.cast("string")))
    ballots = [
        F.struct(
            F.lit(voter).alias("voter"),
            F.lit(i).alias("voter_ord"),
            (F.col("neutral_key") if voter in failed else F.col("vote_key")).alias("vote_key"),
            (F.lit(NEUTRAL) if voter in failed else score(voter, F.col, voters)).alias("score"),
        )
        for i, voter in enumerate(agent_set)
    ]
    return keyed.select("file_id", *EMITTED, F.inline(F.array(*ballots)))


def votes_of(proposed: DataFrame, voter: str) -> DataFrame:
    """Votes of one voter, before duplicate keys are settled."""
    return proposed.select(
        "file_id", *EMITTED, vote_key(F.col).alias("vote_key"), score(voter, F.col).alias("score")
    )


def vote_dedup(votes: DataFrame) -> DataFrame:
    """One score per (file, voter, key): of edits that share a key, the last one counts."""
    last = F.max_by("score", F.struct(*EMITTED))
    return votes.groupBy("file_id", "voter", "voter_ord", "vote_key").agg(last.alias("score"))
