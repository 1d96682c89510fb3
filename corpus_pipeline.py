"""A corpus pipeline: language, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``; all but the last return
the columns of ``documents``.  A stage's result is written as Parquet in the shared folder and read
again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.hilbert import shard_documents
from tidemark.llm.language_mixture import known_language
from tidemark.llm.mixing import mixed
from tidemark.llm.ngram_join import one_per_group
from tidemark.llm.spaced_seeds import decontaminate
from tidemark.llm.store import materialize, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; texts without a letter go."""
    return known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles at Jaccard 0.8 or more."""
    return one_per_group(docs, words=5, p=80, q=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix deals them: up to three times, or not at all; one is cut where its source's quota ends.

    Columns stay; where rows go is decided by the next stage, along its curve.
    """
    return mixed(docs).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their shard and slot along the Hilbert curve; shards are of near equal size."""
    return shard_documents(docs, shards=16, law="bytes")


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The language model and the curve are no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
