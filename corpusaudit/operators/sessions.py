"""Sessions, steps and snapshots as versioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusaudit.functions.text import rows_of
from corpusaudit.operators.metrics import (
    complexity_delta,
    performance_gains,
    security_improvements,
)

ACTIVE = ("started", "in_progress")
RETENTION_DAYS = 30
# Times keep their microseconds in exported documents.
JSON_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
# Steps per exported JSON document.
PAGE = 100

SESSION_SCHEMA = (
    "refactor_id string, target_path string, status string, progress bigint, "
    "started_at timestamp_ntz, updated_at timestamp_ntz, seq bigint"
)


def current_sessions(versions: DataFrame) -> DataFrame:
    """Newest version of every session, by (ts, seq). An aggregate and not a window, so versions
    are reduced before the shuffle and a hot session does not land in one task. A version that
    stands for earlier ones (after a compaction) carries the session's ``started_at``."""
    began = F.coalesce("started_at", "ts") if "started_at" in versions.columns else F.col("ts")
    newest = F.max(F.struct("ts", "seq", "status", "progress", "target_path"))
    return (
        versions.groupBy("refactor_id")
        .agg(newest.alias("v"), F.min(began).alias("started_at"))
        .select(
            "refactor_id",
            F.col("v.target_path").alias("target_path"),
            F.col("v.status").alias("status"),
            F.col("v.progress").alias("progress"),
            "started_at",
            F.col("v.ts").alias("updated_at"),
            F.col("v.seq").alias("seq"),
        )
    )


def lookup(current: DataFrame, wanted: DataFrame) -> DataFrame:
    return current.join(wanted.select("refactor_id"), "refactor_id", "left_semi")


def not_found(current: DataFrame, wanted: DataFrame) -> DataFrame:
    missing = wanted.join(current.select("refactor_id"), "refactor_id", "left_anti")
    return missing.select(
        "refactor_id",
        F.lit("SESSION_NOT_FOUND").alias("code"),
        F.concat(F.lit("Session not found: "), "refactor_id").alias("message"),
    )


def canonical_id(raw: Column) -> Column:
    """The hyphenated form of anything that reads as a UUID, else null."""
    bare = F.replace(F.replace(raw, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    digits = F.lower(F.replace(F.btrim(bare, F.lit("{}")), F.lit("-"), F.lit("")))
    spaced = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), spaced)


def session_catalog(versions: DataFrame) -> DataFrame:
    """Stored ids, without entries whose name is no id."""
    ids = versions.select(canonical_id(F.col("refactor_id")).alias("refactor_id"))
    return ids.filter(F.col("refactor_id").isNotNull()).distinct()


def active_sessions(current: DataFrame) -> DataFrame:
    return current.filter(F.col("status").isin(*ACTIVE)).select(
        "refactor_id", "target_path", "status", "started_at"
    )


def cancel(current: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """One answer per request: any known session is cancelled and completed ``at`` that time, whatever
    its state."""
    known = current.select("refactor_id", F.col("status").alias("previous_status"))
    there = F.col("previous_status").isNotNull()
    return requests.select("refactor_id").join(known, "refactor_id", "left").select(
        "refactor_id", there.alias("cancelled"), "previous_status", F.when(there, at).alias("completed_at")
    )


def cancelled_versions(current: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """The versions to append for cancelled sessions; ``ts`` of the version is when they were completed."""
    return lookup(current, requests).select(
        "refactor_id",
        "target_path",
        at.alias("ts"),
        (F.col("seq") + 1).alias("seq"),
        F.lit("cancelled").alias("status"),
        "progress",
    )


RECORD_SCHEMA = (
    "refactor_id string, target_path string, status string, progress bigint, agent_set array<string>, original_code string, "
    "refactored_code string, evolution_history array<struct<iteration:int,agent:string,change_type:string,confidence:double,"
    "description:string,line_start:int,line_end:int,original_code:string,modified_code:string>>, "
    "consensus_log array<struct<iteration:int,decision:string,winning_agent:string,confidence:double>>, "
    "metrics struct<lines_changed:int,complexity_delta:double,security_improvements:bigint,performance_gains:double,"
    "agent_contributions:map<string,bigint>>, started_at timestamp_ntz, completed_at timestamp_ntz, error_message string"
)


def session_records(results: DataFrame, agent_set: Sequence[str], refactor_id: Column, started_at: Column, completed_at: Column) -> DataFrame:
    """The whole record of each refactored file's session. A file whose text could not be read has failed: it has
    no texts, metrics or time of completion."""
    before, after = F.col("original_code"), F.col("refactored_code")
    failed = F.col("error_message").isNotNull()
    agents = F.transform("steps", lambda s: s["agent"])
    counts = F.map_from_entries(
        F.transform(
            F.array_sort(F.array_distinct(agents)),
            lambda a: F.struct(a, F.size(F.filter(agents, lambda b: b == a)).cast("long")),
        )
    )
    measured = F.struct(
        F.col("lines_changed").alias("lines_changed"),
        complexity_delta(before, after).alias("complexity_delta"),
        security_improvements(before, after).alias("security_improvements"),
        performance_gains(before, after).alias("performance_gains"),
        counts.alias("agent_contributions"),
    )
    return results.select(
        refactor_id.alias("refactor_id"),
        F.col("path").alias("target_path"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(failed, 0).otherwise(100).cast("long").alias("progress"),
        F.array(*[F.lit(a) for a in agent_set]).alias("agent_set"),
        before.alias("original_code"),
        F.when(~failed, after).alias("refactored_code"),
        F.col("steps").alias("evolution_history"),
        F.col("decisions").alias("consensus_log"),
        F.when(~failed, measured).alias("metrics"),
        started_at.alias("started_at"),
        F.when(~failed, completed_at).alias("completed_at"),
        "error_message",
    )


def export_records(records: DataFrame) -> DataFrame:
    """One JSON document per session record."""
    fields = [f.name for f in records.schema.fields]
    return records.select("refactor_id", F.to_json(F.struct(*fields), JSON_OPTIONS).alias("document"))


def import_records(documents: DataFrame) -> DataFrame:
    return documents.select(F.from_json("document", RECORD_SCHEMA, JSON_OPTIONS).alias("r")).select("r.*")


def delete(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows without those of the given sessions; deleting twice changes nothing."""
    return rows.join(requests.select("refactor_id"), "refactor_id", "left_anti")


def session_status(current: DataFrame, steps: DataFrame) -> DataFrame:
    counts = steps.groupBy("refactor_id").agg(F.count("*").alias("n"))
    return current.join(counts, "refactor_id", "left").select(
        "refactor_id",
        "status",
        "progress",
        F.coalesce("n", F.lit(0)).alias("current_iteration"),
        F.col("started_at").alias("last_update"),
    )


def step_history(steps: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Steps in order per session, as sorted rows. The sort splits by (session, iteration), so a
    long history spans several tasks instead of one list in one row."""
    chosen = steps if wanted is None else lookup(steps, wanted)
    return chosen.orderBy("refactor_id", "iteration")


def step_records(best: DataFrame, iteration: int = 0) -> DataFrame:
    """Step rows with the hunk of the edit."""
    hunk = F.format_string(
        "@@ -%d,%d +%d,%d @@\n-%s\n+%s",
        "line_start",
        "line_end",
        "line_start",
        "line_end",
        "original_code",
        "modified_code",
    )
    return best.select(
        "file_id",
        F.lit(iteration).alias("iteration"),
        F.col("agent_id").alias("agent"),
        "change_type",
        "confidence",
        "description",
        hunk.alias("code_diff"),
    )


def snapshot_files(codes: DataFrame, every: int = 5, enabled: bool = True) -> DataFrame:
    """(name, content) of every ``every``-th iteration; input (refactor_id, iteration, code, ts)."""
    kept = codes.filter(F.lit(enabled) & (F.col("iteration") % every == 0))
    iteration = F.col("iteration").cast("string")
    header = F.concat(
        F.lit("# Snapshot - Session: "), "refactor_id", F.lit(", Iteration: "), iteration,
        F.lit("\n# Generated: "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lit("\n\n"),
    )
    name = F.concat("refactor_id", F.lit("_iter_"), iteration, F.lit(".py"))
    return kept.select(name.alias("name"), F.concat(header, "code").alias("content"))


def snapshot_iteration(name: Column) -> Column:
    """Iteration in a snapshot's name: what stands between the first iter_ and the last .py; 0 when
    that is no number."""
    number = F.regexp_extract(name, r"^.*?iter_(.*)\.py", 1)
    return F.coalesce(number.try_cast("bigint"), F.lit(0))


def snapshot_list(names: DataFrame) -> DataFrame:
    """Snapshots of every session with their iteration, in order."""
    own = F.startswith("name", F.concat("refactor_id", F.lit("_iter_"))) & F.endswith(
        F.col("name"), F.lit(".py")
    )
    listed = names.filter(own).select(
        "refactor_id", "name", snapshot_iteration(F.col("name")).alias("iteration")
    )
    return listed.orderBy("refactor_id", "iteration", "name")


def snapshot_retention(
    snapshots: DataFrame, as_of: str, max_snapshots: int = 100, per: str | None = None
) -> DataFrame:
    """Snapshots to keep: not older than 30 days, and of those the newest ``max_snapshots``.

    The cut is a distributed top-k. With ``per`` it is taken within each value of that column; the
    rank limit is applied before the shuffle, so a hot value sends only its newest rows.
    """
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {RETENTION_DAYS} DAYS")
    recent = snapshots.filter(F.col("mtime") >= cutoff)
    newest = (F.desc("mtime"), F.desc("name"))
    if per is None:
        return recent.orderBy(*newest).limit(max_snapshots)
    rank = F.row_number().over(W.partitionBy(per).orderBy(*newest))
    return recent.withColumn("_rank", rank).filter(F.col("_rank") <= max_snapshots).drop("_rank")


def apply_plan(
    results: DataFrame, corpus: DataFrame, force: bool = False, backup: bool = True
) -> DataFrame:
    """Files to write: completed results with text, whose file still holds the original code.

    ``results`` holds (path, status, original_code, refactored_code). Of the corpus only digests
    are shuffled.
    """
    now = corpus.select("path", F.sha2("code", 256).alias("digest"))
    ready = results.select(
        "path",
        rows_of(
            (F.col("status") == "completed") & (F.col("refactored_code") != ""),
            F.struct(F.sha2("original_code", 256).alias("expected"), "refactored_code"),
        ),
    )
    joined = ready.join(now, "path")
    kept = joined if force else joined.filter(F.col("digest") == F.col("expected"))
    copy = F.concat("path", F.lit(".backup")) if backup else F.lit(None).cast("string")
    return kept.select("path", F.col("refactored_code").alias("content"), copy.alias("backup_path"))


def drifted(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """Completed results whose file was changed or removed since."""
    now = corpus.select("path", F.sha2("code", 256).alias("digest"))
    done = results.filter(F.col("status") == "completed").select(
        "path", F.sha2("original_code", 256).alias("expected")
    )
    state = F.when(F.col("digest").isNull(), "missing").otherwise("modified")
    return (
        done.join(now, "path", "left")
        .filter(F.col("digest").isNull() | (F.col("digest") != F.col("expected")))
        .select("path", state.alias("state"))
    )


def backups(plan: DataFrame, corpus: DataFrame) -> DataFrame:
    """(path, content) of the copies to keep of the files that a plan replaces."""
    return corpus.join(plan.select("path", "backup_path"), "path").select(
        F.col("backup_path").alias("path"), F.col("code").alias("content")
    )


def export_sessions(current: DataFrame) -> DataFrame:
    """One JSON document per session."""
    fields = [f.split()[0] for f in SESSION_SCHEMA.split(", ")]
    return current.select("refactor_id", F.to_json(F.struct(*fields), JSON_OPTIONS).alias("document"))


def import_sessions(documents: DataFrame) -> DataFrame:
    parsed = documents.select(F.from_json("document", SESSION_SCHEMA, JSON_OPTIONS).alias("s"))
    return parsed.select("s.*")


def export_steps(steps: DataFrame) -> DataFrame:
    """JSON pages of at most 100 steps each, so no document grows with its session."""
    page = F.floor(F.col("iteration") / PAGE).alias("page")
    step = F.struct("iteration", "agent", "change_type", "confidence", "ts")
    return (
        steps.groupBy("refactor_id", page)
        .agg(F.sort_array(F.collect_list(step)).alias("steps"))
        .select("refactor_id", "page", F.to_json("steps", JSON_OPTIONS).alias("document"))
    )


def result_report(results: DataFrame) -> DataFrame:
    """Results of completed files: status, the agents whose edits were applied, the number of decisions,
    the list of changes made, and the metrics.

    Steps per file are bounded by ``max_iterations``, so they stay beside the file, and the whole
    report is one narrow pass.
    """
    change = F.transform(
        "steps",
        lambda s: F.format_string(
            "%s: %s (confidence: %.2f)", s["agent"], s["description"], s["confidence"]
        ),
    )
    before, after = F.col("original_code"), F.col("refactored_code")
    return results.filter(F.col("error_message").isNull()).select(
        "file_id",
        "path",
        F.size("steps").alias("n_steps"),
        F.array_join(change, "\n").alias("changes"),
        complexity_delta(before, after).alias("complexity_delta"),
        security_improvements(before, after).alias("security_improvements"),
        performance_gains(before, after).alias("performance_gains"),
        "lines_changed",
        F.lit("completed").alias("status"),
        F.sort_array(F.array_distinct(F.transform("steps", lambda s: s["agent"]))).alias("agents"),
        F.size("decisions").alias("n_decisions"),
    )


def agent_contributions(steps: DataFrame) -> DataFrame:
    """Map of agent to number of applied steps per session; counted before it is collected."""
    counts = steps.groupBy("refactor_id", "agent").agg(F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("agent", "n")))
    return counts.groupBy("refactor_id").agg(
        F.map_from_entries(entries).alias("agent_contributions")
    )


def session_totals(versions: DataFrame, results: DataFrame) -> DataFrame:
    """Counters over everything stored: sessions, and rounds in which a decision was taken."""
    ids = versions.groupBy("refactor_id").agg(F.lit(1).alias("sessions"))
    rows = ids.select("sessions", F.lit(0).alias("rounds")).unionByName(
        results.select(F.lit(0).alias("sessions"), F.size("decisions").alias("rounds"))
    )
    return rows.agg(
        F.sum("sessions").alias("sessions_total"), F.sum("rounds").alias("consensus_rounds_total")
    )
