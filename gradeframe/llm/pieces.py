"""Token ids of whole texts through pieces: cut where a tokenizer never joins, ask the library once for each piece.

A batch of texts is one buffer of bytes. Cuts are found by array operations on the buffer, pieces are told
apart by Arrow's dictionary encoding, and only distinct pieces are looked up in the worker's cache. What the
cache does not know goes to the library in one call; a piece goes there whole, so its ids are the library's.

Where cuts are safe follows from the pre-tokenizer of each vocabulary:

* ``word`` (words, single digits, runs of other characters; white space is dropped): before white space,
  around ASCII digits, and between ASCII or Latin-1 letters and ASCII punctuation.
* ``byte`` (the same with a space before, runs of digits, runs of white space): before a space that a
  character follows, around a lone newline, and between ASCII or Latin-1 letters, ASCII digits, and punctuation.

Both read an apostrophe together with letters behind it. Other bytes are never cut, so combining marks stay with
what they belong to. Texts that hold an added token of the vocabulary are cut at spaces alone.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_ENTRIES = 1_000_000
CACHE_IDS = 16_000_000  # ids held by a cache
ASKED = 4_096  # pieces asked at a time
PART = 2 << 20  # bytes of text cut at a time; a longer text is a part of its own

OTHER, LETTER, DIGIT, MARK, SPACE = range(5)
CLASSES = np.zeros(256, np.uint8)
CLASSES[33:127] = MARK
CLASSES[ord("0"):ord("9") + 1] = DIGIT
CLASSES[ord("a"):ord("z") + 1] = CLASSES[ord("A"):ord("Z") + 1] = LETTER
CLASSES[ord(" ")] = SPACE
LATIN = 0xC3  # first byte of the letters from U+00C0 to U+00FF, but for two signs
SIGNS = (0x97, 0xB7)
WHITE = np.isin(np.arange(256), [*range(9, 14), 32])
# First bytes of Unicode's white space; a space before them is not cut off.
WHITE_LEAD = np.isin(np.arange(256), [*range(33), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3])


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def buffer_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text starts and ends; null is empty."""
    column = text.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.empty(0, np.uint8)
    return data, ends - ends[0]


def parts_of(text: pa.Array, most: int = PART) -> Iterator[tuple[int, pa.Array]]:
    """The column in slices of about ``most`` bytes, with the first row of each."""
    lengths = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(lengths) - lengths) // most
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    for a, b in zip(starts, np.append(starts[1:], len(part)) if len(part) else []):
        yield int(a), text.slice(int(a), int(b - a))


def classes_of(data: np.ndarray) -> np.ndarray:
    """Class of every byte; the two bytes of a Latin-1 letter are letters."""
    kind = CLASSES[data]
    lead = np.flatnonzero(data[:-1] == LATIN)
    lead = lead[~np.isin(data[lead + 1], SIGNS)]
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def plain_bytes(data: np.ndarray, ends: np.ndarray, text: pa.Array, added: list[str]) -> np.ndarray | None:
    """Which bytes belong to texts without an added token, in either case; None if all do."""
    found = None
    for token in added:
        here = pc.match_substring(text.fill_null(""), token, ignore_case=True)
        found = here if found is None else pc.or_(found, here)
    if found is None or not pc.any(found).as_py():
        return None
    return np.repeat(~found.to_numpy(zero_copy_only=False), np.diff(ends))


def cuts(data: np.ndarray, rule: str, plain: np.ndarray | None) -> np.ndarray:
    """Where pieces start, but for the starts of texts."""
    start = np.zeros(len(data), bool)
    if len(data) < 2:
        return start
    kind = classes_of(data)
    before, here = kind[:-1], kind[1:]
    inside = lambda k: (k >= LETTER) & (k <= MARK)
    start[1:] = (before != here) & inside(before) & inside(here) & ~((data[:-1] == ord("'")) & (here == LETTER))
    if rule == "word":
        start[1:] |= (here == DIGIT) & inside(before)
        start = start if plain is None else start & plain
        return start | WHITE[data]
    line = np.flatnonzero(data[1:-1] == ord("\n")) + 1
    line = line[inside(kind[line - 1]) & inside(kind[line + 1])]
    start[line] = start[line + 1] = True
    start = start if plain is None else start & plain
    start[:-1] |= (data[:-1] == ord(" ")) & ~WHITE_LEAD[data[1:]]
    return start


def lowered(data: np.ndarray, plain: np.ndarray | None) -> np.ndarray:
    """Capitals of ASCII and Latin-1 in lower case where no combining mark can follow, as such a tokenizer reads them."""
    behind = np.append(data[1:], ord(" "))
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == LATIN) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != SIGNS[0])
    capital = ((data >= ord("A")) & (data <= ord("Z")) | latin) & ((behind < 0x80) | (behind == LATIN))
    return data + np.where(capital if plain is None else capital & plain, 32, 0).astype(np.uint8)


def pieces_of(text: pa.Array, rule: str, lower: bool = False, added: list[str] = ()) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, and of each text its first piece (one more at the end)."""
    data, ends = buffer_of(text)
    plain = plain_bytes(data, ends, text, added)
    start = cuts(data, rule, plain)
    start[ends[:-1][ends[:-1] < ends[1:]]] = True
    at = np.flatnonzero(start)
    data = lowered(data, plain) if lower else np.ascontiguousarray(data)
    pieces = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)])
    return pieces, np.searchsorted(at, ends)


def items_of(column: pa.Array) -> list[bytes]:
    """The values of a large binary column without nulls."""
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1].tolist()
    data = column.buffers()[2].to_pybytes() if len(column) and column.buffers()[2] else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind, values=()):
        self.data, self.size = np.empty(1_024, kind), 0
        self.add(np.asarray(values, kind))

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            larger = np.empty(max(end, 2 * len(self.data)), self.data.dtype)
            larger[:self.size] = self.data[:self.size]
            self.data = larger
        self.data[self.size:end] = values
        self.size = end

    @property
    def values(self) -> np.ndarray:
        return self.data[:self.size]


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... with ``count`` places for each, one after another."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)


class PieceIds:
    """Ids of the pieces met so far. Beyond its bounds the cache keeps the half that was met most often."""

    def __init__(self, tokenizer, rule: str, lower: bool = False, entries: int = CACHE_ENTRIES):
        self.tokenizer, self.rule, self.lower, self.entries = tokenizer, rule, lower, entries
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.index: dict[bytes, int] = {}
        self.count, self.first = Growing(np.int64), Growing(np.int64)  # ids of each piece, and where they are
        self.met = Growing(np.int64)
        self.ids = Growing(np.uint32)

    @classmethod
    def of(cls, path: str, **options) -> PieceIds:
        tokenizer = load_tokenizer(path)
        word = tokenizer.normalizer is not None  # the vocabulary of words reads lower case, the one of bytes all
        return cls(tokenizer, "word" if word else "byte", word, **options)

    def trim(self) -> None:
        """Within bounds again."""
        if len(self.index) <= self.entries and self.ids.size <= CACHE_IDS:
            return
        met = self.met.values
        stay = np.argsort(-met, kind="stable")[:len(met) // 2]
        stay = np.sort(stay[met[stay] > 1])
        pieces = list(self.index)
        self.index = {pieces[i]: n for n, i in enumerate(stay.tolist())}
        self.keep(stay)

    def keep(self, stay: np.ndarray) -> None:
        first, count = self.first.values[stay], self.count.values[stay]
        self.ids = Growing(np.uint32, self.ids.values[spread(first, count)])
        self.first, self.count = Growing(np.int64, np.cumsum(count) - count), Growing(np.int64, count)
        self.met = Growing(np.int64, np.zeros(len(stay)))

    def learn(self, pieces: list[bytes]) -> None:
        """New pieces get the next numbers."""
        self.index.update(zip(pieces, range(len(self.index), len(self.index) + len(pieces))))
        for at in range(0, len(pieces), ASKED):
            asked = [p.decode("utf-8", "replace") for p in pieces[at:at + ASKED]]
            self.add([e.ids for e in self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)])

    def add(self, found: list[list[int]]) -> None:
        count = np.fromiter(map(len, found), np.int64, len(found))
        self.first.add(self.ids.size + np.cumsum(count) - count)
        self.count.add(count)
        self.met.add(np.zeros(len(found)))
        self.ids.add(np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum())))

    def known(self, pieces: pa.Array) -> np.ndarray:
        """Number in the cache of every piece; learns the new ones."""
        self.trim()
        if not len(pieces):
            return np.empty(0, np.int64)
        encoded = pieces.dictionary_encode()
        distinct = items_of(encoded.dictionary)
        number = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        number[new] = len(self.index) + np.arange(len(new))
        self.learn([distinct[i] for i in new.tolist()])
        indices = encoded.indices.to_numpy()
        self.met.values[number] += np.bincount(indices, minlength=len(distinct))
        return number[indices]

    def encoded(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where those of each text start (one more at the end)."""
        pieces, first = pieces_of(text, self.rule, self.lower, self.added)
        number = self.known(pieces)
        count = self.count.values[number]
        ends = np.concatenate([[0], np.cumsum(count)])
        return self.ids.values[spread(self.first.values[number], count)], ends[first]


# A worker keeps its caches from task to task.
CACHES: dict[tuple, object] = {}


def cached(key: tuple, make: Callable):
    """The worker's own object of this key, made at first use; of one file and kind the last is kept."""
    if key not in CACHES:
        for old in [k for k in CACHES if k[:2] == key[:2]]:
            del CACHES[old]
        CACHES[key] = make()
    return CACHES[key]
