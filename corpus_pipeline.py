"""The corpus pipeline: quality rules, near duplicates, benchmark leaks, personal data, source mix.

Each stage takes what the one before it kept, as ``documents`` rows, and returns such rows with its
decisions applied; the last one says how often each remaining document is taken.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from strayfinder.llm import decontamination, jaccard, mixing, pii, quality_rules
from strayfinder.llm.queries import table
from strayfinder.session import checkpoint_folder

#: near duplicates, disclosure and balanced sampling aren't expressible as one DuckDB statement
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no quality rule."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle sets linked at 0.8, that of the smallest id."""
    return jaccard.distinct(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def protect(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that give it away masked in their texts."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of each document the mix takes, balanced to the sources' targets."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", protect),
    ("mixing sources to target weights", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet to a fresh shared folder and read again."""
    folder = f"{checkpoint_folder(spark)}/stages-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}.parquet")
            docs = spark.read.parquet(f"{folder}/{k}.parquet")
    return docs
