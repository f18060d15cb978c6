"""Keep costly columns from being copied around the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def evaluate_once(table: DataFrame, drop: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """Adds (or replaces) columns behind a one-row generator.

    Filters on such a column stay above the generator. In a plain projection the
    optimizer moves the filter below and copies the whole expression into it; with
    parsed JSON read by several tests the copies multiply at every step. The
    generator runs inside the same code stage and moves no data.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [F.col(f"`{c}`") for c in table.columns if c not in columns and c not in drop]
    return table.select(*kept, F.inline(F.array(row)))
