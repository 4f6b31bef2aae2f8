"""Ordinals and running totals over many ranges, against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from corpusaudit.operators import ranking


@pytest.mark.parametrize("rows_per_range", [7, 60, 10**9])
def test_ordinals_and_totals(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(ranking, "ROWS_PER_RANGE", rows_per_range)
    monkeypatch.setattr(ranking, "SAMPLED", 3)
    rng = random.Random(2)
    rows = [(0 if i % 3 == 0 else rng.randrange(9), rng.choice([None, 1, 2, 3]), i, rng.randrange(-3, 9)) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key int, at int, id int, value long").repartition(5)
    low = lambda x: (x is not None, x or 0)  # noqa: E731  nulls first
    got = {r.id: r.n for r in ranking.ordinal_in_group(df, key="key", order=("at", "id"), name="n").collect()}
    want = {}
    for key in range(9):
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (low(r[1]), r[2]))):
            want[r[2]] = n
    assert got == want
    got = {r.id: r.total for r in ranking.running_total(df, value="value", order=("at", "id"), name="total").collect()}
    total, want = 0, {}
    for r in sorted(rows, key=lambda r: (low(r[1]), r[2])):
        total += r[3]
        want[r[2]] = total
    assert got == want


def test_ranges_follow_the_order_and_nothing_is_written(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_RANGE", 500)

    def refuse(*_):
        raise AssertionError("a plan was built by writing")

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.write", property(refuse))
    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 7).alias("k"), F.to_timestamp_ntz(F.lit("2024-01-01")).alias("ts"))
    parts = ranking._in_order(df, ("ts", "id")).groupBy("_part").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
    rows = sorted(parts.collect())
    assert len(rows) >= 30 and max(r.n for r in rows) < 2000
    assert all(x.b < y.a for x, y in zip(rows, rows[1:]))
    assert ranking.ordinal_in_group(df, key="k", order=("ts", "id"), name="n").agg(F.max("n")).first()[0] == 20_000 // 7
