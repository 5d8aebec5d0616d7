"""The corpus pipeline: five stages from raw documents to a mixed training set.

Each stage reads what its predecessor kept and returns documents with their
columns; the last adds topic, weight, expected and copies of each drawn document.
Stages are written as Parquet and read again, so a lost executor costs one stage
at most, and each can be rerun alone.

Defined results
    null or empty text   has no letter, so the language stage drops it
    null doc_id          smaller than any number; kept as it is
    repeated rows        one of them stays
    very long texts      whole in every stage
    ties                 as each stage's module says
    empty table          no rows
    further columns      passed on, but for the four that the last stage adds
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trustlake.llm import decontaminate, exact_dedup, language, mixing, near_dup
from trustlake.llm.common import cut


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents teach."""
    return language.keep_identified(docs, language.sample(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest doc_id of each text."""
    return exact_dedup.drop_copies(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return near_dup.drop_near_copies(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares meet the targets of source, language and topic in
    expectation; documents of values that are too rare for it count as several copies."""
    return mixing.draw(docs)


STAGES = [
    ("language_id", identified),
    ("exact_dedup", distinct),
    ("near_dedup", dissimilar),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
]
# Cross-parsing, similarity joins and edit distances are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
