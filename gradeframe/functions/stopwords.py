"""Stopword lists: the base list, and loading of a caller's own list."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

# The base English stopword list.
BASE = """
a about above after again against all am an and any are aren't as
at be because been before being below between both but by
could couldn't did didn't do does doesn't doing don't down during
each few for from further had hadn't has hasn't have haven't having
he he'd he'll he's her here here's hers herself him himself his how how's
i i'd i'll i'm i've if in into is isn't it it's its itself let's
me more most mustn't my myself no nor not of off on once only or other
ought our ours ourselves out over own same shan't she she'd she'll she's
should shouldn't so some such than that that's the their theirs them
themselves then there there's these they they'd they'll they're they've
this those through to too under until up very was wasn't
we we'd we'll we're we've were weren't what what's when when's where where's
which while who who's whom why why's with won't would wouldn't
you you'd you'll you're you've your yours yourself yourselves
""".split()

def read_stopwords(spark, path: str, list_name: str | None = None) -> DataFrame:
    """A caller's list: text (one word a line) or parquet ``(list_name, word)``."""
    if path.rstrip("/").endswith(".parquet"):
        table = spark.read.parquet(path)
        return table.where(F.col("list_name") == list_name) if list_name else table
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("word"))
    return lines.where("word <> ''").select(F.lit(list_name or "custom").alias("list_name"), "word")


def as_words(stopwords: Iterable[str] | None) -> list[str]:
    """A list of any length, held in the plan as one constant set; ``None`` means the base list.

    A table is never read while a plan is built: it joins, by `drop_stopwords`.
    """
    if stopwords is None:
        return list(BASE)
    if isinstance(stopwords, DataFrame):
        raise TypeError("a table of stopwords joins: use drop_stopwords or cosine_by_terms")
    return sorted(set(stopwords))


def as_literals(stopwords: Iterable[str] | None) -> list[Column]:
    """The list as literals, made once for all columns they are tested against."""
    return [F.lit(word) for word in as_words(stopwords)]


def drop_stopwords(terms: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Rows of ``terms`` whose ``term`` is not in the list, for a list of any size.

    No broadcast hint: Spark compares the list's size with its own threshold,
    and a hot term on the left is split by the adaptive skew join.
    """
    words = stopwords.select(F.col("word").alias("term"))
    return terms.join(words, "term", "left_anti")
