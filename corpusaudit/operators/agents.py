"""Agent profiles: which voters are on, with which settings, and merging of user entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.config import AGENTS

# Name, priority, threshold and switch of the known profiles.
PROFILES = (
    ("pattern_optimizer", 7, 0.6, True),
    ("security_enforcer", 9, 0.8, True),
    ("loop_simplifier", 6, 0.7, True),
    ("performance_optimizer", 5, 0.5, False),
    ("readability_enhancer", 4, 0.4, False),
)
DEFAULT_PRIORITY = 5
DEFAULT_THRESHOLD = 0.5


def profile_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PROFILES, "agent_id string, priority int, confidence_threshold double, enabled boolean"
    )


def unknown_agents(requests: DataFrame) -> DataFrame:
    """Agents that sessions ask for but that no registered profile provides, with the number of
    requests. Requests are counted before they meet the five-row profile table."""
    asked = requests.select(F.explode("agent_set").alias("agent_id")).groupBy("agent_id").agg(
        F.count("*").alias("n_requests")
    )
    known = active_profiles(requests.sparkSession).select("agent_id")
    return asked.join(F.broadcast(known), "agent_id", "left_anti").select(
        "agent_id", F.lit("AGENT_NOT_FOUND").alias("code"), "n_requests"
    )


def _implemented(agent_id: Column) -> Column:
    return agent_id.isin(*AGENTS)


def active_profiles(spark: SparkSession) -> DataFrame:
    """Profiles that are switched on and have an implementation."""
    return profile_table(spark).filter(F.col("enabled") & _implemented(F.col("agent_id")))


def overridden(profiles: DataFrame, overrides: DataFrame) -> DataFrame:
    """Profiles with a user's settings on top: what an override leaves null stays, and an agent without a
    profile gets one from it, switched on unless it says otherwise."""
    own = overrides.select(
        "agent_id", F.col("priority").alias("p"), F.col("confidence_threshold").alias("t"), F.col("enabled").alias("e")
    )
    return profiles.join(own, "agent_id", "full").select(
        "agent_id",
        F.coalesce("p", "priority", F.lit(DEFAULT_PRIORITY)).alias("priority"),
        F.coalesce("t", "confidence_threshold", F.lit(DEFAULT_THRESHOLD)).alias("confidence_threshold"),
        F.coalesce("e", "enabled", F.lit(True)).alias("enabled"),
    )


def active_agents(requests: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """State and settings of every agent that sessions ask for: the profile wins over the
    defaults, and an override over the profile; disabled and missing agents are reported."""
    asked = requests.select(F.explode("agent_set").alias("agent_id")).groupBy("agent_id").agg(
        F.count("*").alias("n_requests")
    )
    profiles = profile_table(requests.sparkSession)
    # five rows; overrides are a table of the user's, joined as Spark sees fit
    profiles = F.broadcast(profiles) if overrides is None else overridden(profiles, overrides)
    state = (
        F.when(F.col("enabled").isNull(), "unknown")
        .when(~F.col("enabled"), "disabled")
        .when(~_implemented(F.col("agent_id")), "no_implementation")
        .otherwise("active")
    )
    return asked.join(profiles, "agent_id", "left").select(
        "agent_id",
        state.alias("state"),
        F.coalesce("priority", F.lit(DEFAULT_PRIORITY)).alias("priority"),
        F.coalesce("confidence_threshold", F.lit(DEFAULT_THRESHOLD)).alias("confidence_threshold"),
        "n_requests",
    )


def merge_registrations(registrations: DataFrame) -> DataFrame:
    """Built-in agents with user registrations: a built-in id wins, later entries win over earlier
    ones. One row per id with the number of entries it stands for.

    ``registrations`` holds (agent_id, module, seq).
    """
    latest = registrations.groupBy("agent_id").agg(
        F.max_by("module", "seq").alias("module"), F.count("*").alias("n_entries")
    )
    builtin = F.col("agent_id").isin(*AGENTS)
    return latest.select(
        "agent_id",
        F.when(builtin, "builtin").otherwise(F.col("module")).alias("module"),
        builtin.alias("shadowed_by_builtin"),
        "n_entries",
    )
