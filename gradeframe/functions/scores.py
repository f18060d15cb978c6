"""Lexical scores as row-local columns: no shuffle, whatever the text length."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def containment_pct(expected_terms: Column, actual_terms: Column) -> Column:
    """Share of the actual terms found among the expected ones, in percent.

    Null when the actual side has no terms.
    """
    matched = F.array_size(F.array_intersect(expected_terms, actual_terms)).cast("double")
    return F.try_divide(matched, F.array_size(actual_terms).cast("double")) * F.lit(100.0)


def sum_of_squares(tokens: Column) -> Column:
    """Sum over distinct tokens of count squared, by run length over the sorted array.

    One more of the same token turns ``run^2`` into ``(run + 1)^2``, which is
    ``2 run + 1`` more; a new token adds one.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def state(token: Column, run: Column, total: Column) -> Column:
        return F.struct(token.alias("token"), run.alias("run"), total.alias("total"))

    def add(so_far: Column, token: Column) -> Column:
        return F.when(
            so_far.token == token,
            state(token, so_far.run + 1, so_far.total + so_far.run * 2 + 1),
        ).otherwise(state(token, one, so_far.total + 1))

    start = state(F.lit(None).cast("string"), zero, zero)
    return F.aggregate(F.sort_array(tokens), start, add, lambda end: end.total)


def cosine_from_squares(expected_sq: Column, actual_sq: Column, both_sq: Column) -> Column:
    """Cosine from the squared norms of the two token bags and of their union.

    ``|a + b|^2 = |a|^2 + |b|^2 + 2 a.b`` gives the dot product in whole numbers.
    One root over the product keeps equal texts at exactly 1.0. Two empty bags
    score 1.0, one empty bag 0.0, a null text null.
    """
    dot = ((both_sq - expected_sq - actual_sq) / 2).cast("double")
    norms = F.sqrt(expected_sq.cast("double") * actual_sq.cast("double"))
    return (
        F.when(expected_sq.isNull() | actual_sq.isNull(), F.lit(None).cast("double"))
        .when((expected_sq == 0) & (actual_sq == 0), F.lit(1.0))
        .when((expected_sq == 0) | (actual_sq == 0), F.lit(0.0))
        .otherwise(dot / norms)
    )
