"""Shapes of physical plans: what is read, what is shuffled, and that nothing is computed twice."""

import pytest

from corpusaudit.operators import apply, consensus, metrics, propose, scan, sessions
from corpusaudit.plans.audit import finding_counts
from corpusaudit.plans.refactor import refactor

# A literal that only one rule of each kind holds.
EDIT_MARK = "getpass"
SCAN_MARK = "(?iu)(ssl"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "corpus")
    rows = [(i, f"m{i}.py", f"x = {i}", "extra") for i in range(64)]
    df = spark.createDataFrame(rows, "file_id bigint, path string, code string, other string")
    df.repartition(16).write.parquet(path)
    return spark.read.parquet(path)


def physical(df):
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical") :]


@pytest.mark.parametrize(
    "build",
    [
        refactor,
        propose.proposals,
        apply.best_change,
        apply.gated_change,
        apply.apply_best,
        apply.apply_mismatch,
        apply.file_decisions,
        lambda f: sessions.result_report(refactor(f)),
        lambda f: metrics.refactor_metrics(refactor(f)),
    ],
)
def test_rounds_are_narrow_and_edits_are_built_once(stored, build):
    plan = physical(build(stored))
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count(EDIT_MARK) == 1
    assert "other" not in plan


@pytest.mark.parametrize("build", [scan.vuln_counts, scan.vuln_matches, finding_counts])
def test_scans_are_narrow_and_rules_run_once(stored, build):
    plan = physical(build(stored))
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count(SCAN_MARK) == 1
    assert "path" not in plan.split("ReadSchema")[-1]


def test_votes_are_shuffled_once_and_without_text(stored):
    plan = physical(consensus.key_scores(propose.proposals(stored)))
    assert plan.count("Exchange") == 1
    shuffled = plan[: plan.index("Exchange")]
    assert "original_code" not in shuffled
    both = physical(consensus.consensus(stored, propose.proposals(stored)))
    assert both.count("Exchange hashpartitioning") <= 2


def test_counts_are_combined_before_the_shuffle(stored):
    plan = physical(scan.vuln_by_category(stored))
    assert plan.count("Exchange") == 1 and "partial_count" in plan


def test_newest_per_session_is_cut_before_the_shuffle(spark):
    df = spark.range(100).selectExpr(
        "concat('s', id % 3) AS refactor_id", "cast(id AS string) AS name",
        "timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(0, id) AS mtime",
    )
    plan = physical(sessions.snapshot_retention(df, "2024-02-15 00:00:00", 5, per="refactor_id"))
    assert plan.count("WindowGroupLimit") == 2
    plan = physical(sessions.snapshot_retention(df, "2024-02-15 00:00:00", 5))
    assert "TakeOrderedAndProject" in plan
