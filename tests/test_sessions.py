import datetime as dt
import uuid

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusaudit.operators import agents, opsmetrics, sessions
from corpusaudit.operators.ranking import _in_order, ordinal_in_group, running_total
from corpusaudit.plans.refactor import refactor
from corpusaudit.sources import files as sources
from corpusaudit.sources import state

T0 = dt.datetime(2024, 1, 1)
VERSION = (
    "refactor_id string, target_path string, ts timestamp_ntz, seq bigint, status string, "
    "progress bigint"
)


def version(sid, minute, seq, status, progress=0):
    return (sid, f"{sid}.py", T0 + dt.timedelta(minutes=minute), seq, status, progress)


@pytest.fixture(scope="module")
def versions(spark):
    return spark.createDataFrame(
        [
            version("a", 0, 0, "started"),
            version("a", 5, 3, "completed", 100),
            version("b", 1, 1, "started"),
            version("b", 1, 2, "in_progress", 10),
            version("c", 2, 4, "failed"),
        ],
        VERSION,
    )


def test_newest_version_wins_and_replay_changes_nothing(spark, versions, tmp_path):
    path = str(tmp_path / "sessions")
    state.save_sessions(versions, path)
    first = sorted(state.load_sessions(spark, path).collect())
    state.save_sessions(versions, path)
    assert sorted(state.load_sessions(spark, path).collect()) == first
    assert {r.refactor_id: r.status for r in first} == {
        "a": "completed",
        "b": "in_progress",
        "c": "failed",
    }
    target = str(tmp_path / "compact")
    state.compact_sessions(spark, path, target)
    assert spark.read.parquet(target).count() == 3
    stored = sorted(state.load_sessions(spark, path).collect())
    assert sorted(state.load_sessions(spark, target).collect()) == stored  # started_at too
    state.save_sessions(spark.read.parquet(path).drop("started_at"), target)
    assert sorted(state.load_sessions(spark, target).collect()) == stored


def test_cancel_any_state_and_unknown(spark, versions):
    current = sessions.current_sessions(versions)
    wanted = spark.createDataFrame([("a",), ("x",)], "refactor_id string")
    at = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    answers = {r.refactor_id: (r.cancelled, str(r.completed_at)) for r in sessions.cancel(current, wanted, at).collect()}
    assert answers == {"a": (True, "2024-01-02 00:00:00"), "x": (False, "None")}
    more = sessions.cancelled_versions(current, wanted, at)
    after = sessions.current_sessions(versions.unionByName(more))
    assert {r.refactor_id: r.status for r in after.collect()}["a"] == "cancelled"


def test_delete_twice(spark, versions):
    gone = spark.createDataFrame([("a",), ("zz",)], "refactor_id string")
    once = sessions.delete(versions, gone)
    assert sorted(sessions.delete(once, gone).collect()) == sorted(once.collect())
    assert {r.refactor_id for r in once.collect()} == {"b", "c"}


def test_ids_read_like_uuids(spark):
    texts = [
        "12345678-1234-5678-1234-567812345678",
        "{12345678123456781234567812345678}",
        "urn:uuid:12345678-1234-5678-1234-56781234567A",
        "1234",
        "bad-12",
        "12345678-1234-5678-1234-56781234567g",
        "",
    ]

    def parse(text):
        try:
            return str(uuid.UUID(text))
        except ValueError:
            return None

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.c for r in df.select(sessions.canonical_id(F.col("t")).alias("c")).collect()]
    assert got == [parse(t) for t in texts]


def test_snapshot_numbers(spark):
    names = {"s_iter_12.py": 12, "s_iter_x.py": 0, "s_iter_.py": 0, "s_iter_7.py.py": 0, "s": 0}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(sessions.snapshot_iteration(F.col("n")).alias("i")).collect()
    assert [r.i for r in got] == list(names.values())


def test_snapshot_files(spark):
    codes = spark.createDataFrame(
        [("s", i, f"code{i}", T0) for i in range(12)],
        "refactor_id string, iteration int, code string, ts timestamp_ntz",
    )
    rows = sessions.snapshot_files(codes).orderBy("name").collect()
    assert [r.name for r in rows] == ["s_iter_0.py", "s_iter_10.py", "s_iter_5.py"]
    assert rows[0].content == (
        "# Snapshot - Session: s, Iteration: 0\n"
        "# Generated: 2024-01-01T00:00:00.000000\n\ncode0"
    )
    assert sessions.snapshot_files(codes, enabled=False).count() == 0


def test_retention_by_age_and_number(spark):
    rows = [("hot" if i % 3 else "cold", f"n{i:04d}", T0 + dt.timedelta(hours=i)) for i in range(1200)]
    df = spark.createDataFrame(rows, "refactor_id string, name string, mtime timestamp_ntz")
    kept = sessions.snapshot_retention(df, "2024-02-15 00:00:00", 50)
    assert {r.name for r in kept.collect()} == {f"n{i:04d}" for i in range(1150, 1200)}
    few = sessions.snapshot_retention(df, "2024-03-20 00:00:00", 50)
    assert few.count() == 24
    per = sessions.snapshot_retention(df, "2024-02-15 00:00:00", 7, per="refactor_id")
    assert {r[0]: r[1] for r in per.groupBy("refactor_id").count().collect()} == {"hot": 7, "cold": 7}


def test_apply_plan_checks_drift(spark):
    results = spark.createDataFrame(
        [
            ("a.py", "completed", "old", "new"),
            ("b.py", "completed", "old", "new"),
            ("c.py", "failed", "old", "new"),
            ("d.py", "completed", "old", ""),
            ("e.py", "completed", "old", "new"),
        ],
        "path string, status string, original_code string, refactored_code string",
    )
    corpus = spark.createDataFrame(
        [(p, "changed" if p == "b.py" else "old") for p in ("a.py", "b.py", "c.py", "d.py")],
        "path string, code string",
    )
    plan = sessions.apply_plan(results, corpus)
    assert [tuple(r) for r in plan.collect()] == [("a.py", "new", "a.py.backup")]
    forced = sessions.apply_plan(results, corpus, force=True)
    assert {r.path for r in forced.collect()} == {"a.py", "b.py"}
    copies = {r.path: r.content for r in sessions.backups(forced, corpus).collect()}
    assert copies == {"a.py.backup": "old", "b.py.backup": "changed"}
    states = {r.path: r.state for r in sessions.drifted(results, corpus).collect()}
    assert states == {"b.py": "modified", "e.py": "missing"}


def test_json_pages_stay_small(spark):
    rows = [("s", i, "a", "security", 0.5, T0) for i in range(250)]
    steps = spark.createDataFrame(
        rows,
        "refactor_id string, iteration bigint, agent string, change_type string, "
        "confidence double, ts timestamp_ntz",
    )
    pages = sessions.export_steps(steps).orderBy("page").collect()
    assert [p.document.count('"iteration"') for p in pages] == [100, 100, 50]


def hot_rows(spark):
    """One key holds more than a third of the rows, one moment half of those."""
    rows = [
        (
            "hot" if i % 3 == 0 else f"k{i % 40}",
            T0 if i % 6 == 0 else T0 + dt.timedelta(seconds=i * 7 % 9000),
            i,
        )
        for i in range(6000)
    ]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, n bigint")


def test_ordinals_of_a_hot_key(spark):
    df = hot_rows(spark)
    got = ordinal_in_group(df, key="k", order=("ts", "n"), name="i")
    want = df.withColumn(
        "i", (F.row_number().over(W.partitionBy("k").orderBy("ts", "n")) - 1).cast("bigint")
    )
    columns = ["k", "ts", "n", "i"]
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())


def test_a_hot_moment_is_split(spark):
    parts = _in_order(hot_rows(spark), ("k", "ts", "n")).groupBy("_part").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 2 * 6000 / 8


def test_running_total_in_buckets(spark):
    df = hot_rows(spark).withColumn("v", (F.col("n") % 5 - 2).cast("int"))
    got = running_total(df, value="v", order=("ts", "n"), name="total")
    want = df.withColumn("total", F.sum("v").over(W.orderBy("ts", "n")))
    columns = ["n", "total"]
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())


def test_latency_buckets_are_cumulative(spark):
    df = spark.createDataFrame(
        [("a", 0.004), ("a", 0.2), ("a", 99.0), ("b", 0.005)], "agent string, seconds double"
    )
    rows = {(r.agent, r.le): r.cumulative for r in opsmetrics.latency_histogram(df).collect()}
    assert rows["a", "0.005"] == 1 and rows["b", "0.005"] == 1
    assert rows["a", "0.25"] == 2 and rows["a", "10.0"] == 2 and rows["a", "inf"] == 3


def test_agents(spark):
    wanted = spark.createDataFrame(
        [(["security_enforcer", "nobody"],), (["readability_enhancer"],)], "agent_set array<string>"
    )
    state_of = {r.agent_id: r.state for r in agents.active_agents(wanted).collect()}
    assert state_of == {
        "security_enforcer": "active",
        "nobody": "unknown",
        "readability_enhancer": "disabled",
    }
    unknown = {r.agent_id for r in agents.unknown_agents(wanted).collect()}
    assert unknown == {"nobody", "readability_enhancer"}
    entries = spark.createDataFrame(
        [("mine", "v1", 1), ("mine", "v2", 2), ("loop_simplifier", "fake", 3)],
        "agent_id string, module string, seq bigint",
    )
    merged = {r.agent_id: r.module for r in agents.merge_registrations(entries).collect()}
    assert merged == {"mine": "v2", "loop_simplifier": "builtin"}


def test_reading_a_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_bytes(b"x = 1\r\ny = 2\rz\n")
    (tmp_path / "sub" / "b.js").write_text("größe")
    (tmp_path / "noext").write_text("")
    rows = sources.read_code_dir(spark, str(tmp_path)).collect()
    texts = {r.path.rsplit("/", 1)[-1]: r.code for r in rows}
    assert texts["a.py"] == "x = 1\ny = 2\nz\n"
    assert texts["b.js"] == "größe"
    assert texts["noext"] == "" and len(rows) == 3  # files of no bytes are listed too


def test_files_that_are_not_utf8_fail_and_are_never_written(spark, tmp_path):
    (tmp_path / "bad.py").write_bytes(b"password = 'x'  # \xff\xfe\n")
    (tmp_path / "ok.py").write_bytes("password = 'größe'\n".encode())
    files = sources.read_code_dir(spark, str(tmp_path))
    failed = sources.failed_files(files).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.error_message) for r in failed] == [("bad.py", "unreadable text")]
    results = refactor(files)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in results.collect()}
    assert rows["bad.py"].refactored_code is None
    assert rows["bad.py"].error_message == "unreadable text"
    assert rows["ok.py"].error_message is None
    plan = sessions.apply_plan(results.withColumn("status", F.lit("completed")), files).collect()
    assert {r.path.rsplit("/", 1)[-1] for r in plan} <= {"ok.py"}


def test_languages(spark):
    paths = {
        "a.py": "python",
        "x/b.tar.rs": "rust",
        "c": "unknown",
        "d.PY": "unknown",
        "e.": "unknown",
        ".py": "python",
        "a.ts": "typescript",
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = df.select(sources.language_of(F.col("path")).alias("l")).collect()
    assert [r.l for r in got] == list(paths.values())


class Cluster:
    """A session that names, or does not name, a shared folder."""

    def __init__(self, folder, master="spark://host:7077"):
        self.conf = {state.CHECKPOINT_DIR: folder} if folder else {}
        self.sparkContext = self
        self.master = master

    def getConf(self):
        return self.conf


def test_shared_folder_comes_from_the_session():
    assert state.new_dir(Cluster("/shared/place/"), "x").startswith("/shared/place/corpusaudit/x-")
    with pytest.raises(ValueError):
        state.new_dir(Cluster(None), "x")
    assert "corpusaudit-" in state.new_dir(Cluster(None, "local[2]"), "x")
