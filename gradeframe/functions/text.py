"""Text normalisation as Spark columns: no Python on the row path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Everything up to and including the space character.
CONTROL_AND_SPACE = "".join(chr(c) for c in range(0x21))

# The code points that count as white space when stripping.
UNICODE_SPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007),
              *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000]
)

# Runs of letters or of decimal digits of the basic plane; all else separates.
# A run never needs to give characters back, and saying so halves the matching time.
TOKEN_RUN = r"[\p{L}&&[\x{0}-\x{FFFF}]]++|[\p{Nd}&&[\x{0}-\x{FFFF}]]++"


def trim_control(text: Column) -> Column:
    """Drop leading and trailing characters up to U+0020 (newlines included)."""
    return F.btrim(text, F.lit(CONTROL_AND_SPACE))


def strip_unicode(text: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.btrim(text, F.lit(UNICODE_SPACE))


def is_blank(text: Column) -> Column:
    """True for null and for text of control characters and spaces only."""
    return F.coalesce(trim_control(text) == "", F.lit(True))


def without(tokens: Column, stopwords: Sequence[str | Column]) -> Column:
    """Multiset filter: keeps order and repeats.

    A literal membership test becomes one constant hash set for the whole plan,
    so the cost per token does not grow with the list.
    """
    if not stopwords:
        return F.filter(tokens, lambda t: t != "")
    return F.filter(tokens, lambda t: (t != "") & ~t.isin(*stopwords))


def keyword_tokens(text: Column) -> Column:
    """Lower-case words of ``a-z``; only the space separates, all else is deleted.

    May hold empty strings: splitting at each single space avoids a pattern, and
    the stopword filter that follows drops the empties anyway.
    """
    return F.split(F.regexp_replace(F.lower(text), "[^a-z ]++", ""), " ")


def keyword_terms(text: Column, stopwords: Sequence[str | Column]) -> Column:
    """Distinct keywords of a text."""
    return F.array_distinct(without(keyword_tokens(text), stopwords))


def class_tokens(text: Column) -> Column:
    """Tokens by character class, reduced to ``a-z0-9``; may hold empty strings.

    A token of letters or digits with as many bytes as characters is plain
    already, so only the others go through the second pattern.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_RUN), F.lit(0))
    return F.transform(
        runs,
        lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(
            F.regexp_replace(t, "[^a-z0-9]", "")
        ),
    )


def drop_short(tokens: Column) -> Column:
    """Tokens of at least two characters."""
    return F.filter(tokens, lambda t: F.length(t) > 1)


def clean_tokens(text: Column, stopwords: Sequence[str | Column]) -> Column:
    """Class tokens without stopwords and without one-character tokens."""
    if not stopwords:
        return drop_short(class_tokens(text))
    return F.filter(class_tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*stopwords))


def without_listed(tokens: Column, listed: Column) -> Column:
    """Tokens that an array column does not hold; the row's own hits are found first, so each token is tested against few."""
    return let(F.array_intersect(tokens, listed), lambda hits: F.filter(tokens, lambda t: ~F.array_contains(hits, t)))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_fence(text: Column, trim=trim_control) -> Column:
    """Remove a Markdown code fence around an already trimmed reply."""
    inner = F.regexp_replace(F.regexp_replace(text, "^```[a-zA-Z]*\\n?", ""), "```$", "")
    return F.when(text.startswith("```"), trim(inner)).otherwise(text)


def reason_lines(reason: Column) -> Column:
    """Lines of a reason; empty lines at the end are dropped, others kept."""
    return F.split(F.regexp_replace(reason, r"(?<!\n)\n+\z", ""), "\n")
