"""A corpus pipeline of five stages; each reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, pieces, pseudonyms, quality, simhash
from quire.llm.shared import clear, table, tables_written, written

#: Models and SimHash have no SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, accepts."""
    return quality.accepted(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; without a key in the session this is a demonstration."""
    return pseudonyms.pseudonymised(docs, pseudonyms.session_key(spark, demonstration=True))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, as piece ids."""
    return pieces.samples(docs, k=2)


STAGES = [
    ("quality", good_quality),
    ("near-duplicates", distinct_documents),
    ("decontamination", without_benchmark),
    ("pseudonyms", pseudonymised),
    ("pieces", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Once a stage's rows are written, its own tables and its predecessor's rows go."""
    docs, mark = table(spark, sf_dir, "documents"), tables_written()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear(spark, mark, keep=1)
    return docs
