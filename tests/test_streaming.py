import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusaudit.operators import scan
from corpusaudit.sources import derived
from corpusaudit.streaming import batches, jobs

T0 = dt.datetime(2024, 1, 1)


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


@pytest.fixture
def docs():
    return [(i, f"line {i}", "src") for i in range(30)]


def test_scan_continues_and_skips_repeats(spark, tmp_path, docs):
    schema = "doc_id bigint, text string, source string"
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))

    def drain():
        arrivals = (
            spark.readStream.schema(schema)
            .parquet(f"{folder}/*")
            .withColumn("arrived_at", F.col("_metadata.file_modification_time"))
        )
        jobs.stream_scan(arrivals, derived.as_code, out, checkpoint)
        return jobs.scan_results(spark, out)

    put(spark, folder, "one", docs[:20], schema)
    first = drain().count()
    put(spark, folder, "two", docs[15:], schema)
    rows = drain()
    whole = derived.as_code(spark.createDataFrame(docs, schema))
    want = scan.vuln_counts(whole.filter("path LIKE '%.py'"))
    assert sorted(rows.collect()) == sorted(want.collect())
    assert first < rows.count()
    assert drain().count() == rows.count()


VERSION = "refactor_id string, ts timestamp, seq bigint, status string, progress bigint"


def test_late_status_loses(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))

    def drain():
        stream = spark.readStream.schema(VERSION).parquet(f"{folder}/*")
        jobs.stream_session_status(stream, out, checkpoint)
        return {r.refactor_id: r.status for r in jobs.session_status_now(spark, out).collect()}

    late = T0 + dt.timedelta(hours=1)
    put(spark, folder, "one", [("a", late, 1, "completed", 100), ("b", T0, 2, "started", 0)], VERSION)
    assert drain() == {"a": "completed", "b": "started"}
    put(spark, folder, "two", [("a", T0, 0, "started", 0), ("b", late, 3, "failed", 0)], VERSION)
    assert drain() == {"a": "completed", "b": "failed"}


def test_counts_grow_over_batches(spark, tmp_path):
    schema = "ts timestamp, agent string, change_type string"
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))

    def drain():
        stream = spark.readStream.schema(schema).parquet(f"{folder}/*")
        jobs.stream_step_counts(stream, out, checkpoint)
        rows = jobs.summed_per_key(spark, out, ["day", "agent", "change_type"]).collect()
        return {(r.day.day, r.agent): r.n_steps for r in rows}

    put(spark, folder, "one", [(T0, "a", "security")] * 3, schema)
    assert drain() == {(1, "a"): 3}
    later = T0 + dt.timedelta(days=1)
    put(spark, folder, "two", [(T0, "a", "security"), (later, "b", "security")], schema)
    assert drain() == {(1, "a"): 4, (2, "b"): 1}
    # Far behind all that was seen: counted all the same.
    put(spark, folder, "three", [(later + dt.timedelta(days=9), "c", "security")], schema)
    drain()
    put(spark, folder, "four", [(T0, "a", "security")], schema)
    assert drain()[1, "a"] == 5


def test_changed_files_are_scanned_again(spark, tmp_path):
    schema = "doc_id bigint, text string, source string"
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))

    def to_code(rows):
        return rows.select(F.col("doc_id").alias("file_id"), F.lit("a.py").alias("path"), F.col("text").alias("code"))

    found = []
    risky, plain = "h = hashlib.md5(x)", "x = 1"
    for name, text in (("one", plain), ("two", risky), ("three", risky), ("four", plain), ("five", risky)):
        put(spark, folder, name, [(1, text, "s")], schema)
        jobs.stream_scan(spark.readStream.schema(schema).parquet(f"{folder}/*"), to_code, out, checkpoint)
        found.append(jobs.scan_results(spark, out).count())
    assert found == [0, 1, 1, 1, 2]  # set back to an earlier text, it is scanned again
    put(spark, folder, "six", [(1, plain, "s"), (1, risky, "s"), (2, risky, "s"), (2, risky, "s")], schema)
    jobs.stream_scan(spark.readStream.schema(schema).parquet(f"{folder}/*"), to_code, out, checkpoint)
    assert jobs.scan_results(spark, out).count() == 3  # file 1 had it last, file 2 is new
    put(spark, folder, "seven", [(1, risky, "s")], schema)
    jobs.stream_scan(spark.readStream.schema(schema).parquet(f"{folder}/*"), to_code, out, checkpoint)
    assert jobs.scan_results(spark, out).count() == 4  # of two texts at once none is known to be the last


def test_batches_are_rolled_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "FAN", 3)
    out, total = str(tmp_path / "t"), 0
    merged = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    for i in range(14):
        rows = spark.createDataFrame([(i % 2, i), (7, 1)], "k int, n long").coalesce(1)
        batches.write_batch(rows, out, i, merged)
        if i in (4, 8):  # replayed after a failure
            batches.write_batch(rows, out, i, merged)
        total += i + 1
        assert batches.read_batches(spark, out).agg(F.sum("n")).first()[0] == total
    assert batches._listed(spark, out, None) == [(0, 12), (0, 13), (1, 3), (2, 0)]
    assert batches.read_batches(spark, out, before=10).agg(F.sum("n")).first()[0] == sum(i + 1 for i in range(10))
    (tmp_path / "t" / "level-2" / "0" / "_SUCCESS").unlink()  # a merge that died
    assert batches.read_batches(spark, out).agg(F.sum("n")).first()[0] == total
    assert batches.read_batches(spark, str(tmp_path / "none"), "k int").count() == 0


def test_ten_thousand_batches_are_read_through_few_folders():
    n, fan = 10_000, batches.FAN
    found = [(level, part) for level in range(4) for part in range(n // fan**level)]
    folders = batches.chosen(found, fan)
    assert len(folders) < 100
    held = [b for level, part in folders for b in range(part * fan**level, (part + 1) * fan**level)]
    assert sorted(held) == list(range(n))


def test_tables_of_one_file_and_of_many(spark, tmp_path):
    rows = [(T0 + dt.timedelta(days=i // 10), "a", "security") for i in range(40)]
    schema = "ts timestamp, agent string, change_type string"
    frame = spark.createDataFrame(rows, schema)
    frame.repartition(4).write.parquet(str(tmp_path / "many" / "t.parquet"))
    frame.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "t.parquet").write_bytes(next((tmp_path / "part").glob("*.parquet")).read_bytes())
    for kind in ("many", "one"):
        stream = jobs.file_stream(spark, str(tmp_path / kind), "t.parquet", files_per_batch=1)
        jobs.stream_step_counts(stream, str(tmp_path / f"out-{kind}"), str(tmp_path / f"check-{kind}"))
        got = jobs.summed_per_key(spark, str(tmp_path / f"out-{kind}"), ["day", "agent", "change_type"]).collect()
        assert sorted(r.n_steps for r in got) == [10, 10, 10, 10]


def test_gauge_over_days(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = [
        ("a", T0, 0, "started", 0),
        ("b", T0, 1, "started", 0),
        ("a", T0 + dt.timedelta(days=1), 2, "completed", 100),
        ("b", T0 + dt.timedelta(days=2), 3, "in_progress", 5),
    ]
    put(spark, folder, "one", rows, VERSION)
    stream = spark.readStream.schema(VERSION).parquet(f"{folder}/*")
    jobs.stream_active_gauge(stream, out, checkpoint)
    got = jobs.active_by_day(spark, out).orderBy("day").collect()
    assert [(r.change, r.active) for r in got] == [(2, 2), (-1, 1), (0, 1)]
