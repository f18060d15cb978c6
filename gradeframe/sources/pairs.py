"""Expected/actual pairs from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """User turn and the assistant turn that follows it.

    Joined on ``(conv_id, turn)``, so even a single huge conversation spreads over
    all tasks; the role filters reach the scan.
    """
    asked = conversations.where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("expected")
    )
    answered = conversations.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("actual")
    )
    return asked.join(answered, ["conv_id", "turn"]).withColumn(
        "pair_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    )


def neighbour_pairs(documents: DataFrame) -> DataFrame:
    """Each document and the one with the next id: long pairs over the whole table."""
    first = documents.select("doc_id", F.col("text").alias("expected"))
    second = documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("actual"))
    return first.join(second, "doc_id")


def named_pairs(table: DataFrame, pair_id: str, expected: str, actual: str) -> DataFrame:
    """Any table with two text columns as ``(pair_id, expected, actual)``."""
    return table.select(
        F.col(pair_id).cast("string").alias("pair_id"),
        F.col(expected).cast("string").alias("expected"),
        F.col(actual).cast("string").alias("actual"),
    )
