"""Consensus: scores per key, the verdict per file, overrides and validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.config import AGENTS
from corpusaudit.functions.text import let
from corpusaudit.operators.vote import EMITTED, Voters, score, vote_key

# Sums of doubles have no fixed order in a distributed plan; verdicts compare at 12 digits so that
# a score that lies exactly on the threshold gets the same verdict on every run.
DIGITS = 12


def voter_weights(agent_set: Sequence[str], weights: Mapping[str, float] | None) -> list[float]:
    """Equal weights, or the given ones scaled to a total of one."""
    if weights is None:
        return [1.0 / len(agent_set)] * len(agent_set)
    total = sum(weights[a] for a in agent_set)
    return [weights[a] / total for a in agent_set]


def _weighted(scores: Column, weights: Sequence[float]) -> Column:
    parts = [F.get(scores, F.lit(i)) * F.lit(w) for i, w in enumerate(weights)]
    return sum(parts[1:], parts[0])


def scored_keys(
    proposed: DataFrame, agent_set: Sequence[str] = AGENTS, voters: Voters | None = None
) -> DataFrame:
    """(file_id, vote_key, scores): the scores of all voters, in the order of ``agent_set``.

    Voters share their keys, so duplicates are settled once for all of them, and the rows that
    are shuffled hold a few numbers and no text. They are shuffled by file, so that whatever is
    aggregated per file afterwards needs no second shuffle.
    """
    ballots = proposed.select(
        "file_id",
        vote_key(F.col).alias("vote_key"),
        *EMITTED,
        F.array(*[score(voter, F.col, voters) for voter in agent_set]).alias("scores"),
    )
    last = F.max_by("scores", F.struct(*EMITTED))
    return ballots.repartition("file_id").groupBy("file_id", "vote_key").agg(last.alias("scores"))


def key_scores(
    proposed: DataFrame,
    agent_set: Sequence[str] = AGENTS,
    weights: Mapping[str, float] | None = None,
    voters: Voters | None = None,
) -> DataFrame:
    w = voter_weights(agent_set, weights)
    return scored_keys(proposed, agent_set, voters).select(
        "file_id", "vote_key", _weighted(F.col("scores"), w).alias("key_score")
    )


def verdict(n_keys: Column, average: Column, threshold: float) -> Column:
    return (
        F.when(F.coalesce(n_keys, F.lit(0)) == 0, "no_changes")
        .when(F.round(average, DIGITS) >= threshold, "accept_changes")
        .otherwise("reject_changes")
    )


def _settled(
    n_keys: Column, average: Column, averages: Column, agent_set: Sequence[str], threshold: float
) -> list[Column]:
    """decision, winning_agent and confidence. Of voters with equal averages the first one wins."""
    decision = verdict(n_keys, average, threshold)
    ranked = F.array(
        *[
            F.struct(F.round(F.get(averages, F.lit(i)), DIGITS), F.lit(-i), F.lit(a).alias("agent"))
            for i, a in enumerate(agent_set)
        ]
    )
    winner = F.when(decision == "accept_changes", F.array_max(ranked)["agent"]).otherwise("none")
    confidence = (
        F.when(decision == "no_changes", 0.0)
        .when(decision == "accept_changes", average)
        .otherwise(1.0 - average)
    )
    return [
        decision.alias("decision"),
        winner.alias("winning_agent"),
        confidence.alias("confidence"),
    ]


def consensus(
    files: DataFrame,
    proposed: DataFrame,
    threshold: float = 0.6,
    agent_set: Sequence[str] = AGENTS,
    weights: Mapping[str, float] | None = None,
    voters: Voters | None = None,
) -> DataFrame:
    """One decision per file, with the average of every voter (null where nothing was voted on)."""
    ids = files.select("file_id")
    if not agent_set:
        return ids.select(
            "file_id",
            F.lit("no_consensus").alias("decision"),
            F.lit("none").alias("winning_agent"),
            F.lit(0.0).alias("confidence"),
            F.lit(0).cast("long").alias("n_keys"),
            F.array().cast("array<double>").alias("voter_averages"),
        )
    w = voter_weights(agent_set, weights)
    scores = F.col("scores")
    per_file = (
        scored_keys(proposed, agent_set, voters)
        .groupBy("file_id")
        .agg(
            F.count("*").alias("n_keys"),
            F.avg(_weighted(scores, w)).alias("average"),
            F.array(*[F.avg(F.get(scores, F.lit(i))) for i in range(len(agent_set))]).alias(
                "voter_averages"
            ),
        )
    )
    joined = ids.join(per_file, "file_id", "left")
    n_keys = F.col("n_keys")
    settled = _settled(n_keys, F.col("average"), F.col("voter_averages"), agent_set, threshold)
    return joined.select(
        "file_id", *settled, F.coalesce(n_keys, F.lit(0)).alias("n_keys"), "voter_averages"
    )


def decide(
    edits: Column,
    agent_set: Sequence[str],
    threshold: float,
    weights: Mapping[str, float] | None = None,
    voters: Voters | None = None,
) -> Column:
    """The same decision as a struct, from a file's array of edits that count in the vote, with the number
    of keys and the average of every voter."""
    w = voter_weights(agent_set, weights)
    matrix = F.transform(edits, lambda e: F.array(*[score(v, lambda f: e[f], voters) for v in agent_set]))

    def from_matrix(m: Column) -> Column:
        def mean(value) -> Column:
            total = F.aggregate(m, F.lit(0.0), lambda acc, row: acc + value(row))
            return F.try_divide(total, F.size(m))

        average = mean(lambda row: _weighted(row, w))
        averages = F.array(*[mean(lambda row, i=i: F.get(row, F.lit(i))) for i in range(len(w))])
        return let(
            F.struct(average.alias("average"), averages.alias("averages")),
            lambda v: F.struct(
                *_settled(F.size(m), v["average"], v["averages"], agent_set, threshold),
                F.size(m).cast("long").alias("n_keys"),
                F.when(F.size(m) > 0, v["averages"]).alias("voter_averages"),
            ),
        )

    return let(matrix, from_matrix)


def priority_override(
    decisions: DataFrame, priority: Sequence[str], agent_set: Sequence[str] = AGENTS
) -> DataFrame:
    """A priority voter with an average above 0.9 or below 0.1 decides; the last such one wins."""
    position = {a: i for i, a in enumerate(agent_set)}
    rulings = []
    for agent in reversed([a for a in priority if a in position]):
        # A voter with nothing to vote on has the average 0 and thereby rejects.
        average = F.coalesce(F.get("voter_averages", F.lit(position[agent])), F.lit(0.0))
        rounded = F.round(average, DIGITS)
        for name, strong, sure in (
            ("priority_override_accept", rounded > 0.9, average),
            ("priority_override_reject", rounded < 0.1, 1.0 - average),
        ):
            rulings.append(
                F.when(
                    strong & (F.col("decision") != "no_consensus"),
                    F.struct(
                        F.lit(name).alias("decision"),
                        F.lit(agent).alias("winning_agent"),
                        sure.alias("confidence"),
                    ),
                )
            )
    own = F.struct("decision", "winning_agent", "confidence")
    ruled = decisions.withColumn("ruling", F.coalesce(*rulings, own))
    return ruled.select(
        "file_id",
        F.col("ruling.decision"),
        F.col("ruling.winning_agent"),
        F.col("ruling.confidence"),
        "n_keys",
        "voter_averages",
    )


def validated_decisions(decisions: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Adds ``valid``: an acceptance needs the threshold, a rejection 0.5."""
    sure = F.round("confidence", DIGITS)
    valid = (
        F.when(
            F.col("decision").isin("accept_changes", "priority_override_accept"), sure >= threshold
        )
        .when(F.col("decision").isin("reject_changes", "priority_override_reject"), sure >= 0.5)
        .otherwise(True)
    )
    return decisions.withColumn("valid", valid)
