"""A training corpus from ``documents``, stage by stage.

Each stage works on all that the one before kept; what it returns is written
as Parquet in the shared checkpoint folder and read again as the next stage's
documents. All but the last return the columns of ``documents``.

Defined results: null, empty and letterless texts have no language and go in the first stage;
of rows with equal texts the one with the largest id stays, and of similar ones the one with the smallest;
rows that repeat each other whole stay together; rows without an id
stay where an id would be needed to tell them apart; empty tables give no rows; extra columns
pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cavitas.llm import bpe, decontaminate, exact_dedup, language_id, simhash_similarity
from cavitas.session import scratch_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go."""
    return language_id.keep_known(docs, language_id.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: shingles of five words, similarity 0.8 or more."""
    return simhash_similarity.deduplicate(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document that is left, encoded and decoded."""
    return bpe.round_trip(docs, bpe.vocabulary_path())


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", benchmark_free),
    ("bpe_encoding", tokens),
]
#: SQL can't express the language model, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_folder(spark, "corpus")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
