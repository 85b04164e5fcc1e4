"""A corpus job over `documents`: each stage reads what its predecessor wrote as Parquet.

Toxic documents go, one document of each group of near copies stays, contaminated documents go, the
sources are mixed to their weights, and what is left is written as token files and described.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from conceptframe.llm.decontaminate import decontaminated
from conceptframe.llm.jaccard import without_near_copies
from conceptframe.llm.mixing import mixed
from conceptframe.llm.shared import kept
from conceptframe.llm.tokenfiles import token_files
from conceptframe.llm.toxicity import accepted, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the classifier finds toxic; it learns from the labels of its input."""
    return accepted(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold benchmark passages."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what they hold of each."""
    return token_files(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]
#: A trained classifier and a tokenizer are no SQL; tests hold the job against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
