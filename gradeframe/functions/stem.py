"""Porter stemming of token arrays.

The algorithm is the published one (M. F. Porter, "An algorithm for suffix
stripping", 1980) with its author's later revisions: ``bli`` and ``logi`` in
the second step, and words of one or two letters left alone.

It is the one Python step of the package. Spark hands over Arrow batches; they
are worked on in slices of bounded token count, each dictionary-encoded, and a
task remembers the words it met, so memory does not follow the length of texts
and a common word is stemmed once. Nothing is shuffled.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# The functions travel with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The suffix tables of the published algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _longest(suffixes) -> re.Pattern:
    return re.compile("(?:" + "|".join(sorted(suffixes, key=len, reverse=True)) + r")\Z")


_STEP_2, _STEP_3, _STEP_4 = _longest(STEP_2), _longest(STEP_3), _longest(STEP_4)
# A word without any of these endings is its own stem.
_ANY_ENDING = "(?:" + "|".join(["s", "ed", "ing", "y", "e", "ll", *STEP_2, *STEP_3, *STEP_4]) + ")$"
# In a shape string: v for a vowel, c for a consonant.
_VC = re.compile("v+c+")


def _shape(stem: str) -> str:
    """The stem as v/c letters; y is a vowel after a consonant only."""
    out = []
    for ch in stem:
        vowel = ch in "aeiou" or (ch == "y" and bool(out) and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(_VC.findall(_shape(stem)))


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return len(word) > 2 and _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _plurals_and_participles(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    ending = re.search("(?:ed|ing)\\Z", word)
    if not ending or "v" not in _shape(word[: ending.start()]):
        return word
    stem = word[: ending.start()]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_consonant(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    if _measure(stem) == 1 and _short_end(stem):
        return stem + "e"
    return stem


def _replace(word: str, pattern: re.Pattern, table: dict[str, str]) -> str:
    found = pattern.search(word)
    if found and _measure(word[: found.start()]) > 0:
        return word[: found.start()] + table[found.group()]
    return word


def _drop_step_4(word: str) -> str:
    found = _STEP_4.search(word)
    if not found:
        return word
    stem = word[: found.start()]
    if found.group() == "ion" and not stem.endswith(("s", "t")):
        return word
    return stem if _measure(stem) > 1 else word


def _tidy_end(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def porter_stem(word: str) -> str:
    """Stem of one lower-case word."""
    if len(word) < 3 or not word.isalpha():
        return word
    word = _plurals_and_participles(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, _STEP_2, STEP_2)
    word = _replace(word, _STEP_3, STEP_3)
    return _tidy_end(_drop_step_4(word))


# Bounds of a task: tokens worked on at once (or one row, if it has more), and words remembered with their stems.
SLICE_TOKENS, WORDS_KEPT = 1 << 20, 1 << 17
_SIDES = ["first", "other", "both"]


def _stems_of(words: pa.Array, stem: Callable[[str], str]) -> pa.Array:
    changing = pc.match_substring_regex(words, _ANY_ENDING)
    stems = pa.array([stem(w) for w in words.filter(changing).to_pylist()], pa.string())
    return pc.replace_with_mask(words, changing, stems)


def _stem_values(values: pa.Array, stem: Callable[[str], str] = porter_stem) -> pa.Array:
    coded = values.dictionary_encode()
    return _stems_of(coded.dictionary.cast(pa.string()), stem).take(coded.indices)


def _ends(tokens: pa.Array) -> np.ndarray:
    """Where each row's tokens end, counted from the first row; 0 ahead of them."""
    counts = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def _slices(tokens: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold ``SLICE_TOKENS`` at most, or one row."""
    ends, start = _ends(tokens), 0
    while start < len(tokens):
        stop = int(np.searchsorted(ends, ends[start] + SLICE_TOKENS, "right")) - 1
        yield start, max(stop, start + 1)
        start = max(stop, start + 1)


@F.arrow_udf(T.StringType())
def stem_words(words: pa.Array) -> pa.Array:
    """Stem of each word of a string column."""
    return _stem_values(words)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Stem of each token of an array column, order and repeats kept."""
    stem = lru_cache(WORDS_KEPT)(porter_stem)
    for batch in batches:
        for start, stop in _slices(batch):
            tokens = batch.slice(start, stop - start)
            ends = pa.array(_ends(tokens), pa.int32())
            yield pa.ListArray.from_arrays(ends, _stem_values(tokens.flatten(), stem), mask=tokens.is_null())


def _squares(tokens: pa.Array, n_first: np.ndarray, stem: Callable[[str], str]) -> list[np.ndarray]:
    """Per row: sums of squared counts of the stems of its first tokens, of the others, and of all."""
    ends, coded = _ends(tokens), tokens.flatten().dictionary_encode()
    stems = _stems_of(coded.dictionary.cast(pa.string()), stem)
    long = pc.greater(pc.utf8_length(stems), 1).to_numpy(zero_copy_only=False)
    stems = stems.dictionary_encode()
    place = coded.indices.to_numpy(zero_copy_only=False)
    code = stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)[place]
    row = np.repeat(np.arange(len(tokens)), np.diff(ends))
    second = np.arange(ends[-1]) >= (ends[:-1] + n_first)[row]
    keys, counts = np.unique(((row * max(len(stems.dictionary), 1) + code) * 2 + second)[long[place]], return_counts=True)
    row = keys // (2 * max(len(stems.dictionary), 1))
    first, other, dot = (np.zeros(len(tokens), np.int64) for _ in range(3))
    np.add.at(first, row[keys % 2 == 0], counts[keys % 2 == 0] ** 2)
    np.add.at(other, row[keys % 2 == 1], counts[keys % 2 == 1] ** 2)
    met = np.flatnonzero(keys[1:] // 2 == keys[:-1] // 2)  # both sides of a stem stand side by side
    np.add.at(dot, row[met], counts[met] * counts[met + 1])
    return [first, other, first + other + 2 * dot]


@F.arrow_udf(T.StructType([T.StructField(side, T.LongType()) for side in _SIDES]))
def stem_squares(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Squared norms of two bags of stems of two characters and more, and of their union.

    The bags come as one array of tokens and the number of those that belong to the first. Null for a null array.
    """
    stem = lru_cache(WORDS_KEPT)(porter_stem)
    for tokens, n_first in batches:
        for start, stop in _slices(tokens):
            part = tokens.slice(start, stop - start)
            none = part.is_null()
            firsts = n_first.slice(start, stop - start).fill_null(0).to_numpy(zero_copy_only=False)
            sums = [pc.if_else(none, None, pa.array(x)) for x in _squares(part, firsts, stem)]
            yield pa.StructArray.from_arrays(sums, _SIDES)
