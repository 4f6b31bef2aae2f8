"""A training-data pipeline over ``documents``: drop what the quality classifier rejects, drop exact
copies, keep one of each group of near copies, mix the sources to their targets, and encode.

Near copies are told by five-word shingles and a similarity of 0.8. Every stage but the last returns
the columns of the documents; the last adds the token ids. A stage works on all rows that the one
before kept, and each result is stored before the next stage reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusaudit.llm import bpe, exact, mixing, quality, setsketch
from corpusaudit.llm.queries import VOCABULARY
from corpusaudit.llm.store import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setsketch.deduplicate(docs, width=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(docs, VOCABULARY)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]
ORACLE_SQL = None  # neither the classifier nor the encoder can be expressed in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
