"""Every stage of the pipeline on nulls, empty and very long texts, ties, repeated rows, clashing columns and
an empty table."""

import collections

import pytest

import corpus_pipeline
from corpusaudit.llm.store import written

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, row string, score double, hash string, ids array<int>, node long"
LONG = " ".join(f"w{i % 997}x" for i in range(40_000))
ROWS = [
    (1, "The cat sat on the mat and looked at the dog", "en", "a", 3), (1, "The cat sat on the mat and looked at the dog", "en", "a", 3),
    (2, "the CAT sat on the mat and looked at the dog", None, "a", None), (3, None, "en", None, 0), (4, "", "en", "", 0), (5, " \t\n", "en", "b", 3),
    (None, "no id here at all, is there", "en", "b", 1), (None, None, None, None, None), (6, LONG, "en", "c", 1), (7, LONG + " more", "en", "c", 1),
    (1, "another text of one", "en", "a", 1), (8, "<|endoftext|> it's 12 \U0001F600", "en", "c", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, "x", 0.5, "h", [1], 4) for r in ROWS], SCHEMA).repartition(3)


def key(r):
    return (str(r["doc_id"]), str(r["text"]))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, odd, name, stage):
    rows = written(stage(spark, odd, SMALL), "edges").collect()
    before = collections.Counter(map(key, odd.collect()))
    kept = collections.Counter(map(key, rows))
    if name == "encode":
        assert kept == before and all(r["ids"] == [] for r in rows if not (r["text"] or "").strip())
        return
    assert rows == [] or list(rows[0].asDict()) == odd.columns
    if name == "mix":
        assert set(kept) <= set(before) and all(kept[k] <= 2 * before[k] for k in kept)
        return
    assert not kept - before  # nothing is made up or multiplied
    if name == "exact_dedup":
        texts = [str(r["text"] or "").lower() for r in rows]
        assert len(set(texts)) == len(texts) == len({(t or "").lower() for _, t, *_ in ROWS})
    if name == "near_dedup":
        assert sum(r["text"] in (LONG, LONG + " more") for r in rows) == 1
        assert {r["doc_id"] for r in rows} == {1, 3, 4, 5, 6, 8, None}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, odd, name, stage):
    out = stage(spark, odd.limit(0), SMALL)
    assert out.count() == 0 and set(odd.columns) <= set(out.columns) | {"ids"}
