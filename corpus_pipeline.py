"""From raw documents to packed training sequences, in five stages.

Language identification, exact dedup, near-duplicate removal, mixing to target weights, packing. Each
stage takes (spark, docs, folder of tables) and works on all that its predecessor kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gradeframe.llm import exact_dedup, language, mixing, near_join, packing
from gradeframe.llm.common import read_table, shared_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, all of which have a language; null and letterless texts go."""
    return language.keep_known(docs)


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group of equal texts."""
    return exact_dedup.keep_first(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each class of near duplicates."""
    return near_join.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them."""
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in the sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("exact_dedup", one_of_equal),
    ("near_dedup", one_of_similar),
    ("mixing", mixed),
    ("packing", packed),
]

# Predictions, hashes, samples and token ids cannot be told in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
