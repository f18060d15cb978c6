"""Lexical scores of expected/actual pairs.

All of these are projections over the pair's own row: a text's tokens are never
shuffled, and a hot pair or source cannot gather in one task. The only form
that shuffles is `cosine_by_terms`, for a stopword table too long to be held
in the plan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scores, text
from ..functions.stem import stem_squares, stem_tokens, stem_words
from ..functions.stopwords import as_literals, drop_stopwords
from .staging import evaluate_once

Stopwords = Iterable[str] | None

# Fixed value: containment must be strictly above this percentage.
CONTAINMENT_THRESHOLD = 60.0


def with_containment(
    pairs: DataFrame, stopwords: Stopwords = None, threshold: float = CONTAINMENT_THRESHOLD
) -> DataFrame:
    """Adds ``containment_pct`` and ``is_valid`` from ``expected`` and ``actual``."""
    words = as_literals(stopwords)
    terms = evaluate_once(
        pairs,
        _expected=text.keyword_terms(F.col("expected"), words),
        _actual=text.keyword_terms(F.col("actual"), words),
    )
    scored = evaluate_once(
        terms, drop=("_expected", "_actual"),
        containment_pct=scores.containment_pct(F.col("_expected"), F.col("_actual")),
    )
    return scored.withColumn("is_valid", F.coalesce(F.col("containment_pct") > threshold, F.lit(False)))


def _cosine_of(tokens: DataFrame) -> DataFrame:
    """``cosine`` from token arrays ``_expected`` and ``_actual``.

    Texts without a common token need no third fold: their norms just add up.
    """
    both = F.when(
        F.arrays_overlap("_expected", "_actual"), scores.sum_of_squares(F.concat("_expected", "_actual"))
    ).otherwise(F.col("_e") + F.col("_a"))
    norms = evaluate_once(
        tokens, _e=scores.sum_of_squares(F.col("_expected")), _a=scores.sum_of_squares(F.col("_actual"))
    )
    squares = evaluate_once(norms, drop=("_expected", "_actual"), _both=both)
    return evaluate_once(
        squares, drop=("_e", "_a", "_both"),
        cosine=scores.cosine_from_squares(F.col("_e"), F.col("_a"), F.col("_both")),
    )


def with_cosine(pairs: DataFrame, stopwords: Iterable[str] | DataFrame) -> DataFrame:
    """Adds ``cosine`` (0 to 1) over cleaned tokens without stemming.

    The list has no default: this score goes with a longer one than the base list, which callers bring. A table
    with a ``word`` column becomes one constant array by a scalar subquery, so the pairs do not move and nothing is
    read while the plan is built; it should have thousands of words at most, `cosine_by_terms` takes any number.
    """
    if isinstance(stopwords, DataFrame):
        tokens = evaluate_once(
            pairs, _expected=text.clean_tokens(F.col("expected"), []), _actual=text.clean_tokens(F.col("actual"), []))
        # A subquery stands in a column, not in a lambda.
        listed = tokens.withColumn("_words", stopwords.select(F.collect_set("word")).scalar())
        return _cosine_of(evaluate_once(
            listed, drop=("_words",), _expected=text.without_listed(F.col("_expected"), F.col("_words")),
            _actual=text.without_listed(F.col("_actual"), F.col("_words"))))
    words = as_literals(stopwords)
    return _cosine_of(
        evaluate_once(
            pairs,
            _expected=text.clean_tokens(F.col("expected"), words),
            _actual=text.clean_tokens(F.col("actual"), words),
        )
    )


def with_stemmed_cosine(pairs: DataFrame, stopwords: Stopwords = None) -> DataFrame:
    """Adds ``cosine`` over stemmed tokens: stopword test, then stem, then length test.

    Both sides go to Python as one array, so a word they share is stemmed once, and the squared norms come back.
    """
    words = as_literals(stopwords)
    tokens = evaluate_once(
        pairs,
        _expected=text.without(text.class_tokens(F.col("expected")), words),
        _actual=text.without(text.class_tokens(F.col("actual")), words),
    )
    squares = evaluate_once(
        tokens, drop=("_expected", "_actual"),
        _squares=stem_squares(F.concat("_expected", "_actual"), F.size("_expected")),
    )
    return evaluate_once(
        squares, drop=("_squares",),
        cosine=scores.cosine_from_squares(*[F.col(f"_squares.{side}") for side in ("first", "other", "both")]),
    )


def stemmed(column: Column, words: list[Column]) -> Column:
    """Stemmed tokens of a text column, before the length test."""
    return stem_tokens(text.without(text.class_tokens(column), words))


def with_stemmed_tokens(table: DataFrame, column: str, stopwords: Stopwords = None) -> DataFrame:
    """Adds ``tokens``: cleaned and stemmed, in text order."""
    return table.withColumn("tokens", text.drop_short(stemmed(F.col(column), as_literals(stopwords))))


def stem_vocabulary(table: DataFrame, column: str, stopwords: Stopwords = None) -> DataFrame:
    """Distinct terms of a text column with their stems.

    Repeats are dropped inside each row and then map-side before the shuffle,
    so a term found everywhere costs one row per task.
    """
    terms = text.without(text.class_tokens(F.col(column)), as_literals(stopwords))
    return (
        table.select(F.explode(F.array_distinct(terms)).alias("term"))
        .distinct()
        .withColumn("stem", stem_words(F.col("term")))
    )


def with_cosine_verdict(pairs: DataFrame, stopwords: Iterable[str] | DataFrame) -> DataFrame:
    """Adds ``cosine_pct``, ``status`` and ``message`` against the ``threshold`` column.

    A null text or threshold is a failed row without a score, not a failed job.
    """
    scored = with_cosine(pairs, stopwords).withColumn(
        "_pct", F.when(F.col("threshold").isNotNull(), F.col("cosine") * 100)
    )
    shown = F.col("_pct").cast("float").cast("string")
    problem = F.when(F.col("expected").isNull() | F.col("actual").isNull(), "text is null").otherwise(
        "threshold is null"
    )
    passed = F.col("_pct") >= F.col("threshold")
    return (
        scored.withColumn("status", F.when(passed, "PASS").otherwise("FAIL"))
        .withColumn(
            "message",  # fixed values: the texts
            F.when(F.col("_pct").isNull(), F.concat(F.lit("Error: "), problem))
            .when(passed, F.concat(F.lit("Similarity Matched | Score: "), shown))
            .otherwise(F.concat(F.lit("Not Matched | Score: "), shown)),
        )
        .withColumnRenamed("_pct", "cosine_pct")
        .drop("cosine")
    )


def counted_terms(pairs: DataFrame, key: str) -> DataFrame:
    """Long form of both sides' cleaned tokens, counted in the pair's own row: term, e and a.

    The tokens of both sides are sorted as one array, those of the actual text with a space behind them, so equal
    tokens lie in runs and the two runs of a term side by side. No table of terms is kept. Each pair adds one row
    with an empty term whose counts are 1 where a text is present, so a pair without tokens is not lost.
    """
    def tokens(column: str) -> Column:
        return F.coalesce(text.clean_tokens(F.col(column), []), F.array().cast("array<string>"))

    def row(term: Column, e: Column, a: Column) -> Column:
        return F.struct(term.alias("term"), e.cast("bigint").alias("e"), a.cast("bigint").alias("a"))

    def after(t: Column) -> Column:
        return F.concat(t, F.lit(" "))

    def run(first: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_start", k + 1), F.size("_tokens"))
        return F.struct(F.get("_tokens", first).alias("token"), (end - first).alias("n"))

    def term(found: Column, k: Column) -> Column:
        before, behind = F.get("_runs", k - 1), F.get("_runs", k + 1)
        both = behind["token"].eqNullSafe(after(found["token"]))
        return (
            F.when(~found["token"].endswith(" "), row(found["token"], found["n"], F.when(both, behind["n"]).otherwise(0)))
            .when(~after(before["token"]).eqNullSafe(found["token"]), row(F.rtrim(found["token"]), F.lit(0), found["n"]))
        )

    rows = evaluate_once(
        pairs.select(key, "expected", "actual"), drop=("expected", "actual"),
        _present=row(F.lit(""), F.col("expected").isNotNull(), F.col("actual").isNotNull()),
        _tokens=F.sort_array(F.concat(tokens("expected"), F.transform(tokens("actual"), after))),
    )
    first = F.transform("_tokens", lambda t, i: F.when(~t.eqNullSafe(F.get("_tokens", i - 1)), i))
    rows = evaluate_once(rows, _start=F.filter(first, lambda i: i.isNotNull()))
    rows = evaluate_once(rows, drop=("_tokens", "_start"), _runs=F.transform("_start", run))
    terms = F.filter(F.transform("_runs", term), lambda t: t.isNotNull())
    return rows.select(key, F.inline(F.concat(F.array("_present"), terms)))


def cosine_by_terms(pairs: DataFrame, stopwords: DataFrame, key: str = "pair_id") -> DataFrame:
    """Cosine as joins and aggregates, for a stopword table of any length.

    Counts are combined on ``(key, term)`` first, in the pair's own row, so a hot term costs one row per pair
    before the stopword join and a task holds the terms of one pair. ``key`` names one pair; rows that share a
    key count as one pair, and only theirs are aggregated on ``(key, term)``.
    """
    rows = pairs.select(key, "expected", "actual").withColumn("_rows", F.count("*").over(Window.partitionBy(key)))
    shared = counted_terms(rows.where("_rows > 1"), key).groupBy(key, "term")
    counts = counted_terms(rows.where("_rows = 1"), key).unionByName(
        shared.agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    )
    kept = drop_stopwords(counts, stopwords.where("word <> ''"))
    marker = F.col("term") == ""
    total = lambda x: F.coalesce(F.sum(F.when(~marker, x)), F.lit(0))
    norms = kept.groupBy(key).agg(
        total(F.col("e") * F.col("e")).alias("ee"),
        total(F.col("a") * F.col("a")).alias("aa"),
        total((F.col("e") + F.col("a")) * (F.col("e") + F.col("a"))).alias("both"),
        F.max(F.when(marker, F.col("e") > 0)).alias("has_e"),
        F.max(F.when(marker, F.col("a") > 0)).alias("has_a"),
    )
    cosine = scores.cosine_from_squares(
        F.when(F.col("has_e"), F.col("ee")), F.when(F.col("has_a"), F.col("aa")), F.col("both")
    )
    return norms.select(key, cosine.alias("cosine"))
