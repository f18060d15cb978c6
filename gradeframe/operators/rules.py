"""Input rules: a broken row becomes a reject, never a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank
from ..functions.variants import first_of

# Bounds of the score threshold and of the pair count.
THRESHOLD_RANGE = (0, 100)
COUNT_RANGE = (1, 50)


def _not_blank(column: str, label: str) -> Column:
    return F.when(is_blank(F.col(column)), f"{label} must not be empty.")


def judge_input_error() -> Column:
    """First broken rule of ``expected``, ``actual``, ``prompt``, ``threshold``."""
    in_range = F.coalesce(F.col("threshold").between(*THRESHOLD_RANGE), F.lit(False))
    return first_of(
        _not_blank("expected", "Expected_Response"),
        _not_blank("actual", "Actual_Response"),
        _not_blank("prompt", "Prompt"),
        F.when(~in_range, "Similarity_Threshold must be an integer between 0 and 100."),
    )


def question_input_error() -> Column:
    """First broken rule of ``content`` (bytes), ``query_count`` and ``prompt``."""
    low, high = COUNT_RANGE
    count = F.col("query_count")
    return first_of(
        F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "Document_File_Path must not be empty."),
        F.when(F.coalesce(count < low, F.lit(True)), "Query_Count must be a positive integer."),
        F.when(count > high, "Query_Count must not exceed 50."),
        _not_blank("prompt", "Prompt"),
    )


def with_input_error(table: DataFrame, error: Column) -> DataFrame:
    """Adds ``input_error`` (null when all rules hold) and ``error_kind``."""
    return table.withColumn("input_error", error).withColumn(
        "error_kind", F.when(F.col("input_error").isNotNull(), "INPUT")
    )


def split_rejects(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that passed and rows that did not; together they are the input."""
    good = checked.where("input_error is null").drop("input_error", "error_kind")
    return good, checked.where("input_error is not null")
