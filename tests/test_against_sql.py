"""Spark results against the SQL twins: on the given tables and on a dense random corpus."""

import collections
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusaudit.operators import apply, consensus, lines, metrics, opsmetrics, propose, scan, sessions, vote
from corpusaudit.plans import audit, catalog
from corpusaudit.plans.refactor import refactor
from oracle import sql
from tests import fuzz

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
FOLDER = "/root/testdata/sf0.001"


def counted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        return float(x) if isinstance(x, decimal.Decimal) else x

    return collections.Counter(tuple(value(r[i]) for i in order) for r in rows)


def check(df, db, statement):
    result = db.execute(statement)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    theirs = counted(names, result.fetchall())
    ours = counted(df.columns, df.collect())
    assert not list((ours - theirs).items())[:3]
    assert not list((theirs - ours).items())[:3]


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_given_tables(spark, tables, name):
    df = entry.queries()[name](spark, FOLDER)
    statement = entry.oracle_sql().get(name)
    if statement is None:
        assert df.count() > 0
    else:
        check(df, tables, statement)


@pytest.fixture(scope="module")
def random_corpus(spark, corpus_of):
    codes = fuzz.texts(1500)
    files = corpus_of(*codes).repartition(8).cache()
    db = duckdb.connect()
    db.execute("CREATE TABLE fuzz (file_id BIGINT, path VARCHAR, code VARCHAR)")
    db.executemany(
        "INSERT INTO fuzz VALUES (?, ?, ?)", [(i, f"m{i}.py", c) for i, c in enumerate(codes)]
    )
    return files, db


ON_FILES = {
    "code_lines": lines.code_lines,
    "line_context": lines.line_context,
    "line_indent": lines.line_indent,
    "block_end": lines.block_ends,
    "nested_loop_sites": lines.nested_loop_sites,
    "loop_counts": lines.loop_counts,
    "numbered_listing": lines.numbered_listing,
    "vuln_counts": scan.vuln_counts,
    "vuln_matches": scan.vuln_matches,
    "detect_pattern_issues": scan.detect_pattern_issues,
    "detect_loop_issues": scan.detect_loop_issues,
    "finding_counts": audit.finding_counts,
    "all_proposals": propose.proposals,
    "collect_votes": lambda f: vote.collect_votes(propose.proposals(f)),
    "collect_votes_failed": lambda f: vote.collect_votes(
        propose.proposals(f), failed=["loop_simplifier"]
    ),
    "vote_dedup": lambda f: vote.vote_dedup(vote.collect_votes(propose.proposals(f))),
    "key_scores": lambda f: consensus.key_scores(propose.proposals(f)),
    "consensus": lambda f: consensus.consensus(f, propose.proposals(f)).drop("voter_averages"),
    "consensus_winner": lambda f: apply.file_decisions(f).select("file_id", "winning_agent", "voter_averages"),
    "consensus_weighted": lambda f: apply.file_decisions(f, weights=catalog.WEIGHTS).drop("voter_averages"),
    "priority_override": lambda f: consensus.priority_override(
        consensus.consensus(f, propose.proposals(f)), catalog.PRIORITY
    ).drop("voter_averages"),
    "validated_decisions": lambda f: consensus.validated_decisions(
        consensus.consensus(f, propose.proposals(f))
    ).drop("voter_averages"),
    "meaningful_changes": apply.meaningful_changes,
    "best_change": apply.best_change,
    "gated_change": apply.gated_change,
    "apply_best": lambda f: apply.apply_best(f).drop("original_code"),
    "apply_mismatch": apply.apply_mismatch,
    "refactor_fixpoint": lambda f: catalog._fixpoint(refactor(f)),
    "validate_security": lambda f: metrics.validate_security(refactor(f)),
    "complexity": metrics.complexity_report,
    "complexity_delta": lambda f: refactor(f).select(
        "file_id",
        metrics.complexity_delta(*_pair()).alias("complexity_delta"),
    ),
    "security_improvements": lambda f: refactor(f).select(
        "file_id", metrics.security_improvements(*_pair()).alias("security_improvements")
    ),
    "performance_gains": lambda f: refactor(f).select(
        "file_id", metrics.performance_gains(*_pair()).alias("performance_gains")
    ),
    "lines_changed_multiset": lambda f: metrics.lines_changed_multiset(refactor(f)),
    "refactor_metrics": lambda f: metrics.refactor_metrics(refactor(f)),
    "result_report": lambda f: sessions.result_report(refactor(f)),
    "convergence_report": lambda f: opsmetrics.convergence_report(refactor(f)),
}


def _pair():
    from pyspark.sql import functions as F

    return F.col("original_code"), F.col("refactored_code")


@pytest.mark.parametrize("name", sorted(ON_FILES))
def test_random_corpus(random_corpus, name):
    files, db = random_corpus
    statement = sql.statements()[name].replace(
        sql.CORPUS, "corpus AS MATERIALIZED (SELECT * FROM fuzz)"
    )
    check(catalog.plain(ON_FILES[name](files)), db, statement)
