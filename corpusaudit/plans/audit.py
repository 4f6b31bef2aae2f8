"""Read-only audit of a corpus: findings, complexity and confidence per file and agent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions.pyast import syntax
from corpusaudit.functions.text import py_strip
from corpusaudit.operators.scan import findings_per_agent


def agent_analysis(files: DataFrame) -> DataFrame:
    """One row per file and agent.

    A text that does not parse gives zeros from the pattern and loop agents and an error row from
    the security agent, and so does a file whose text could not be read; a blank text has complexity
    0 for the security agent.
    """
    parsed = files.select("file_id", "code", syntax(F.col("code")).alias("s"))
    facts = parsed.select(
        "file_id",
        F.col("s.valid").alias("valid"),
        F.col("s.cyclomatic").cast("double").alias("cyclomatic"),
        F.coalesce(py_strip(F.col("code")) == "", F.lit(False)).alias("blank"),
        "code",
    )
    found = findings_per_agent(facts, "valid", "cyclomatic", "blank")
    valid, is_security = F.col("valid"), F.col("agent_id") == "security_enforcer"
    kept = valid | (is_security & F.col("blank"))
    no_labels = F.array().cast("array<string>")
    measured = F.when(is_security & F.col("blank"), 0.0).when(valid, F.col("cyclomatic"))
    zero_or_error = F.when(~is_security, 0.0)
    return found.select(
        "file_id",
        "agent_id",
        F.when(kept, F.col("issues_found")).when(~is_security, 0).alias("issues_found"),
        F.coalesce(measured, zero_or_error).alias("complexity_score"),
        F.when(kept & is_security, F.col("labels")).otherwise(no_labels).alias("security_risks"),
        F.when(kept & ~is_security, F.col("labels"))
        .otherwise(no_labels)
        .alias("optimization_opportunities"),
        F.when(kept, F.col("confidence")).when(~is_security, 0.0).alias("confidence"),
        F.when(~kept & is_security, "SYNTAX_ERROR").alias("error"),
    )


def analysis_counts(files: DataFrame) -> DataFrame:
    """Findings and confidence per file and agent, with the zeros and errors of texts that do not parse."""
    return agent_analysis(files).select("file_id", "agent_id", "issues_found", "confidence", "error")


def finding_counts(files: DataFrame) -> DataFrame:
    """Findings and confidence per file and agent, as if every text parsed: JVM only, one pass."""
    return findings_per_agent(files).select("file_id", "agent_id", "issues_found", "confidence")
