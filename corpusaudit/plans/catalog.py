"""Every operator as a query over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.config import AuditConfig
from corpusaudit.operators import agents, apply, consensus, lines, metrics, opsmetrics, propose
from corpusaudit.operators import rulepack, scan, sessions, vote
from corpusaudit.operators.useragents import UserAgent
from corpusaudit.plans.audit import agent_analysis, analysis_counts, finding_counts
from corpusaudit.plans.refactor import refactor
from corpusaudit.sources import derived, files, state
from corpusaudit.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

CONFIG = AuditConfig()
AS_OF = "2024-02-15 00:00:00"
PRIORITY = ("loop_simplifier", "security_enforcer")
WEIGHTS = {"pattern_optimizer": 7.0, "security_enforcer": 9.0, "loop_simplifier": 6.0}
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def plain(df: DataFrame) -> DataFrame:
    """The same rows in plain types: long, double with nine digits, text."""
    columns = []
    for field in df.schema.fields:
        c, kind = F.col(field.name), field.dataType.simpleString()
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind == "double":
            c = F.round(c, 9)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, TIME_FORMAT)
        elif kind == "array<string>":
            c = F.array_join(c, "|")
        elif kind == "array<double>":
            c = F.array_join(F.transform(c, lambda x: F.format_string("%.6f", x)), "|")
        elif kind == "map<string,bigint>":
            c = F.array_join(
                F.transform(
                    F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
                ),
                "|",
            )
        columns.append(c.alias(field.name))
    return df.select(*columns)


def _corpus(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: operator(derived.code_corpus(spark, sf))


def _proposals(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return _corpus(lambda c: operator(propose.proposals(c)))


def _agent_proposals(agent: str) -> Query:
    return _proposals(lambda p: p.filter(F.col("agent_id") == agent).drop("agent_ord"))


def _round(operator: Callable[[DataFrame], DataFrame]) -> Query:
    """An operator over texts before and after one round."""
    return _corpus(lambda c: operator(apply.apply_best(c)))


def _refactored(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return _corpus(lambda c: operator(refactor(c)))


def _decisions(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return _corpus(lambda c: operator(apply.file_decisions(c)))


def _current(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.current_sessions(derived.session_versions(spark, sf))


def _delta(name: str, measure: Callable) -> Query:
    return _refactored(
        lambda p: p.select(
            "file_id", measure(F.col("original_code"), F.col("refactored_code")).alias(name)
        )
    )


def _fixpoint(results: DataFrame, *more: str) -> DataFrame:
    return results.select(
        "file_id",
        *more,
        "refactored_code",
        F.size("steps").alias("n_steps"),
        F.size("decisions").alias("n_decisions"),
        "rounds",
        "reason",
    )


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def _with_user_rules(spark: SparkSession, sf: str) -> DataFrame:
    agent = UserAgent.from_table("user_rules", derived.loop_rules(spark, sf), lambda field: field("confidence"))
    done = refactor(derived.code_corpus(spark, sf), agents=[agent])
    by_user = F.filter("steps", lambda s: s["agent"] == "user_rules")
    return _fixpoint(done.withColumn("user_steps", F.size(by_user)), "user_steps")


def _results(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("file_id") % 11 == 0, "failed").otherwise("completed")
    return refactor(derived.code_corpus(spark, sf)).withColumn("status", status)


def _apply_plan(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.apply_plan(_results(spark, sf), derived.edited_corpus(spark, sf))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Whole session records, written as JSON and read back."""
    file_id = F.col("file_id")
    started = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=file_id)
    records = sessions.session_records(
        refactor(derived.damaged_corpus(spark, sf)), CONFIG.agent_set, derived.session_key(file_id), started, _as_of()
    )
    back = sessions.import_records(sessions.export_records(records))
    return back.select(
        "refactor_id", "target_path", "status", "progress", "agent_set", "original_code", "refactored_code",
        F.size("evolution_history").alias("n_steps"), F.size("consensus_log").alias("n_decisions"),
        F.transform("evolution_history", lambda s: s["modified_code"]).alias("edits"),
        "metrics.*", "started_at", "completed_at", "error_message",
    )


def _step_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.steps(spark, sf)
    path = state.new_dir(spark, "steps")
    state.append(rows, path)
    return state.read_back(spark, path, rows)


def _session_store(spark: SparkSession, sf: str) -> DataFrame:
    path = state.new_dir(spark, "sessions")
    state.save_sessions(derived.session_versions(spark, sf), path)
    return state.load_sessions(spark, path)


def _purge(spark: SparkSession, sf: str) -> DataFrame:
    kept = sessions.delete(derived.snapshots(spark, sf), derived.dropped_sessions(spark, sf))
    return kept.select("refactor_id", "name")


def _user_rules(spark: SparkSession, sf: str) -> DataFrame:
    proposed = rulepack.apply_rule_table(
        derived.code_corpus(spark, sf), derived.user_rules(spark, sf), "user_rules", 3
    )
    return proposed.select("file_id", "rule_id", "line_start", "modified_code", "confidence")


def _stream_scan(spark: SparkSession, sf: str) -> DataFrame:
    base = state.new_dir(spark, "scan")
    arrivals = jobs.file_stream(spark, sf, "documents.parquet").select(
        "doc_id", "text", "source"
    )
    jobs.stream_scan(arrivals, derived.as_code, f"{base}/out", f"{base}/checkpoint")
    return jobs.scan_results(spark, f"{base}/out")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    events = jobs.file_stream(spark, sf, "events.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _stream_steps(spark: SparkSession, sf: str) -> DataFrame:
    base = state.new_dir(spark, "steps")
    steps = _event_stream(spark, sf).select(
        "ts",
        derived.agent_of(F.col("event_id")).alias("agent"),
        derived.change_type_of(F.col("event_id")).alias("change_type"),
    )
    jobs.stream_step_counts(steps, f"{base}/out", f"{base}/checkpoint")
    return jobs.summed_per_key(spark, f"{base}/out", ["day", "agent", "change_type"])


def _stream_status(spark: SparkSession, sf: str) -> DataFrame:
    base = state.new_dir(spark, "status")
    versions = derived.as_session_versions(_event_stream(spark, sf))
    jobs.stream_session_status(versions, f"{base}/out", f"{base}/checkpoint")
    return jobs.session_status_now(spark, f"{base}/out")


def _stream_gauge(spark: SparkSession, sf: str) -> DataFrame:
    base = state.new_dir(spark, "gauge")
    versions = derived.as_session_versions(_event_stream(spark, sf))
    jobs.stream_active_gauge(versions, f"{base}/out", f"{base}/checkpoint")
    return jobs.active_by_day(spark, f"{base}/out")


CATALOG: dict[str, Query] = {
    # sources, sinks and state
    "code_corpus": derived.code_corpus,
    "invalid_targets": lambda spark, sf: files.invalid_targets(
        derived.target_requests(spark, sf), derived.code_corpus(spark, sf)
    ),
    "unknown_agents": lambda spark, sf: agents.unknown_agents(derived.agent_requests(spark, sf)),
    "language_mix": _corpus(files.language_mix),
    "python_files": _corpus(lambda c: files.python_files(c).select("file_id", "path")),
    "active_agents": lambda spark, sf: agents.active_agents(derived.agent_requests(spark, sf)),
    "active_agents_overridden": lambda spark, sf: agents.active_agents(
        derived.agent_requests(spark, sf), derived.profile_overrides(spark, sf)
    ),
    "rule_pack_merge": lambda spark, sf: agents.merge_registrations(
        derived.agent_registrations(spark, sf)
    ),
    "session_upsert": _session_store,
    "session_lookup": lambda spark, sf: sessions.lookup(
        _current(spark, sf), derived.wanted_sessions(spark, sf)
    ),
    "session_not_found": lambda spark, sf: sessions.not_found(
        _current(spark, sf), derived.wanted_sessions(spark, sf)
    ),
    "session_catalog": lambda spark, sf: sessions.session_catalog(
        derived.session_versions(spark, sf)
    ),
    "active_sessions": lambda spark, sf: sessions.active_sessions(_current(spark, sf)),
    "session_cancel": lambda spark, sf: sessions.cancel(
        _current(spark, sf), derived.wanted_sessions(spark, sf), _as_of()
    ),
    "session_cancelled_versions": lambda spark, sf: sessions.cancelled_versions(
        _current(spark, sf), derived.wanted_sessions(spark, sf), _as_of()
    ),
    "session_delete": lambda spark, sf: sessions.delete(
        derived.session_versions(spark, sf), derived.dropped_sessions(spark, sf)
    ),
    "session_status": lambda spark, sf: sessions.session_status(
        _current(spark, sf), derived.unnumbered_steps(spark, sf)
    ),
    "step_log_append": _step_log,
    "step_history": lambda spark, sf: sessions.step_history(derived.steps(spark, sf)),
    "step_records": _corpus(lambda c: sessions.step_records(apply.best_change(c))),
    "snapshot_sample": lambda spark, sf: sessions.snapshot_files(derived.round_codes(spark, sf)),
    "snapshot_list": lambda spark, sf: sessions.snapshot_list(derived.snapshots(spark, sf)),
    "snapshot_retention": lambda spark, sf: sessions.snapshot_retention(
        derived.snapshots(spark, sf), AS_OF
    ),
    "snapshot_retention_per_session": lambda spark, sf: sessions.snapshot_retention(
        derived.snapshots(spark, sf), AS_OF, 3, per="refactor_id"
    ),
    "session_purge": _purge,
    "apply_plan": _apply_plan,
    "apply_backups": lambda spark, sf: sessions.backups(
        _apply_plan(spark, sf), derived.edited_corpus(spark, sf)
    ),
    "apply_drift": lambda spark, sf: sessions.drifted(_results(spark, sf), derived.edited_corpus(spark, sf)),
    "session_records": _records,
    "session_json_roundtrip": lambda spark, sf: sessions.import_sessions(
        sessions.export_sessions(_current(spark, sf))
    ),
    "result_report": _refactored(sessions.result_report),
    "numbered_listing": _corpus(lines.numbered_listing),
    # lines
    "code_lines": _corpus(lines.code_lines),
    "line_context": _corpus(lines.line_context),
    "line_indent": _corpus(lines.line_indent),
    "block_end": _corpus(lines.block_ends),
    "nested_loop_sites": _corpus(lines.nested_loop_sites),
    "loop_counts": _corpus(lines.loop_counts),
    # detection
    "vuln_counts": _corpus(scan.vuln_counts),
    "vuln_by_category": _corpus(scan.vuln_by_category),
    "vuln_matches": _corpus(scan.vuln_matches),
    "top_risky_files": _corpus(scan.top_risky_files),
    "detect_pattern_issues": _corpus(scan.detect_pattern_issues),
    "detect_loop_issues": _corpus(scan.detect_loop_issues),
    "unsafe_rewrites": _proposals(
        lambda p: p.filter(scan.is_unsafe(F.col("modified_code"))).select(
            "file_id", "rule_id", "line_start"
        )
    ),
    "finding_counts": _corpus(finding_counts),
    "analysis_counts": lambda spark, sf: analysis_counts(derived.damaged_corpus(spark, sf)),
    "agent_analysis": lambda spark, sf: agent_analysis(derived.damaged_corpus(spark, sf)),
    "failed_files": lambda spark, sf: files.failed_files(derived.damaged_corpus(spark, sf)),
    # proposals
    "propose_security": _agent_proposals("security_enforcer"),
    "propose_pattern": _agent_proposals("pattern_optimizer"),
    "propose_loop": _agent_proposals("loop_simplifier"),
    "all_proposals": _corpus(propose.proposals),
    "proposals_by_type": _proposals(propose.proposals_by_type),
    "user_rule_proposals": _user_rules,
    "user_rule_counts": lambda spark, sf: rulepack.scan_rule_table(
        derived.code_corpus(spark, sf), derived.user_rules(spark, sf)
    ),
    # votes and consensus
    "votes_security": _proposals(lambda p: vote.votes_of(p, "security_enforcer")),
    "votes_pattern": _proposals(lambda p: vote.votes_of(p, "pattern_optimizer")),
    "votes_loop": _proposals(lambda p: vote.votes_of(p, "loop_simplifier")),
    "collect_votes": _proposals(vote.collect_votes),
    "collect_votes_failed": _proposals(
        lambda p: vote.collect_votes(p, failed=["loop_simplifier"])
    ),
    "vote_dedup": _proposals(lambda p: vote.vote_dedup(vote.collect_votes(p))),
    "key_scores": _proposals(consensus.key_scores),
    "consensus": _decisions(lambda d: d.drop("voter_averages")),
    "consensus_winner": _decisions(lambda d: d.select("file_id", "winning_agent", "voter_averages")),
    "priority_override": _decisions(
        lambda d: consensus.priority_override(d, PRIORITY).drop("voter_averages")
    ),
    "validated_decisions": _decisions(
        lambda d: consensus.validated_decisions(d).drop("voter_averages")
    ),
    "consensus_weighted": _corpus(
        lambda c: apply.file_decisions(c, weights=WEIGHTS).drop("voter_averages")
    ),
    # rounds
    "meaningful_changes": _corpus(apply.meaningful_changes),
    "best_change": _corpus(apply.best_change),
    "gated_change": _corpus(apply.gated_change),
    "apply_best": _round(lambda p: p.drop("original_code")),
    "apply_mismatch": _corpus(apply.apply_mismatch),
    "refactor_fixpoint": _refactored(_fixpoint),
    "refactor_with_user_rules": _with_user_rules,
    "convergence_report": _refactored(opsmetrics.convergence_report),
    "progress_timeline": _refactored(
        lambda r: opsmetrics.progress_timeline(r, CONFIG.max_iterations)
    ),
    "validate_security": _refactored(metrics.validate_security),
    "validate_pattern": _refactored(metrics.validate_pattern),
    "validate_loop": _refactored(metrics.validate_loop),
    # before and after
    "complexity": _corpus(metrics.complexity_report),
    "syntax_report": _corpus(metrics.syntax_report),
    "cyclomatic": _corpus(metrics.cyclomatic),
    "complexity_delta": _delta("complexity_delta", metrics.complexity_delta),
    "security_improvements": _delta("security_improvements", metrics.security_improvements),
    "performance_gains": _delta("performance_gains", metrics.performance_gains),
    "lines_changed_exact": _refactored(metrics.lines_changed_exact),
    "lines_changed_multiset": _refactored(metrics.lines_changed_multiset),
    "unified_diff": _refactored(metrics.diffs),
    "refactor_metrics": _refactored(metrics.refactor_metrics),
    "agent_contributions": lambda spark, sf: sessions.agent_contributions(
        derived.unnumbered_steps(spark, sf)
    ),
    "validate_corpus": _corpus(metrics.validate_corpus),
    # operations
    "session_totals": lambda spark, sf: sessions.session_totals(
        derived.session_versions(spark, sf), refactor(derived.code_corpus(spark, sf))
    ),
    "active_gauge": lambda spark, sf: opsmetrics.active_gauge(derived.session_versions(spark, sf)),
    "latency_histogram": lambda spark, sf: opsmetrics.latency_histogram(
        derived.latencies(spark, sf)
    ),
    # streams
    "stream_scan": _stream_scan,
    "stream_step_counts": _stream_steps,
    "stream_session_status": _stream_status,
    "stream_active_gauge": _stream_gauge,
}


def _plain_query(query: Query) -> Query:
    return lambda spark, sf: plain(query(spark, sf))


def queries() -> dict[str, Query]:
    return {name: _plain_query(query) for name, query in CATALOG.items()}
