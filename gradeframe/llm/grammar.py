"""Re-Pair grammar of a run of token ids, and the binary form of a shard.

Frequent pairs of symbols are replaced by new symbols, round after round: a round counts all pairs, takes the
frequent ones at once, and settles where they overlap (the more frequent pair, alternating places in a run of one
symbol). A pair never reaches over the end of a document. Rounds end when no pair occurs ``LEAST`` times or a round
saves less than ``GAIN`` of the symbols.

A shard is, all little-endian: ``HEADER``; the doc_ids (8 bytes each) and whether each is there (1 byte each);
the number of ids of each document (4 bytes each); the rules (two symbols of 4 bytes each) and their expansion
lengths (4 bytes each); the place among the ids of every ``STRIDE``-th symbol (8 bytes each); and the symbols (2 or 4
bytes each). A symbol below ``base`` is a token id, another one the rule of number symbol - base. Rules only
name earlier rules. With the places and expansion lengths any range of ids is decoded from the symbols that hold it.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, VERSION = b"IDRP", 1
HEADER = struct.Struct("<4sHHIIQIIQ")  # magic, version, symbol bytes, base, stride, documents, rules, places, symbols
LEAST, GAIN, STRIDE = 16, 0.02, 1_024
BUCKETS = 18  # bits of the hash that pairs are counted by


def chosen_places(rank: np.ndarray) -> np.ndarray:
    """Places whose rank is above those of both neighbours; of a run of equal ranks every other one takes part."""
    at = np.flatnonzero(rank)
    if not len(at):
        return at
    value = rank[at]
    joined = (at[1:] == at[:-1] + 1) & (value[1:] == value[:-1])
    start = np.maximum.accumulate(np.where(np.concatenate([[True], ~joined]), np.arange(len(at)), 0))
    stays = (np.arange(len(at)) - start) % 2 == 0
    left = np.zeros(len(rank) + 2, rank.dtype)
    left[at[stays] + 1] = value[stays]
    found = []
    for _ in range(2):  # what lost to a place that itself lost gets a second chance
        best = at[(left[at + 1] > left[at]) & (left[at + 1] > left[at + 2])]
        found.append(best)
        left[best] = left[best + 1] = left[best + 2] = 0
    return np.sort(np.concatenate(found))


def compress(ids: np.ndarray, last: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules and expansion lengths; ``last`` marks the last id of each document."""
    symbols, last = ids.astype(np.int64), last.copy()
    rules, lengths = [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)]
    total = base  # symbols so far; the expansion lengths of all of them
    size = np.ones(base, np.int64)
    while len(symbols) > 1:
        pair = symbols[:-1] << 32 | symbols[1:]
        slot = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS)).astype(np.int64)
        slot[last[:-1]] = 1 << BUCKETS  # a bucket of no pair
        hot = np.flatnonzero((np.bincount(slot, minlength=(1 << BUCKETS) + 1)[:-1] >= LEAST).take(slot, mode="clip") & ~last[:-1])
        # One pair stands for its bucket in this round; others of the bucket wait for the next.
        stands = np.empty(1 << BUCKETS, np.int64)
        stands[slot[hot]] = pair[hot]
        hot = hot[stands[slot[hot]] == pair[hot]]
        count = np.bincount(slot[hot], minlength=1 << BUCKETS)
        hot = hot[count[slot[hot]] >= LEAST]
        rank = np.zeros(len(pair), np.int64)
        rank[hot] = count[slot[hot]] << BUCKETS | slot[hot]
        at = chosen_places(rank)
        taken = np.bincount(slot[at], minlength=1 << BUCKETS)
        at = at[taken[slot[at]] >= LEAST]
        if len(at) < GAIN * len(symbols):
            break
        new = np.flatnonzero(taken >= LEAST)
        rule = np.stack([stands[new] >> 32, stands[new] & 0xFFFFFFFF], axis=1)
        rules.append(rule)
        lengths.append(size[rule].sum(axis=1))
        size = np.concatenate([size, lengths[-1]])
        number = np.empty(1 << BUCKETS, np.int64)
        number[new] = total + np.arange(len(new))
        total += len(new)
        symbols[at] = number[slot[at]]
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
    return symbols, np.concatenate(rules), np.concatenate(lengths)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids of the symbols, one level of the grammar at a time."""
    symbols = symbols.astype(np.int64)
    while (nested := symbols >= base).any():
        width = np.where(nested, 2, 1)
        first = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        out[first] = np.where(nested, 0, symbols)
        pairs = rules[symbols[nested] - base]
        out[first[nested]], out[first[nested] + 1] = pairs[:, 0], pairs[:, 1]
        symbols = out
    return symbols.astype("<u4")


def write_shard(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, base: int) -> bytes:
    """The bytes of a shard: documents one after another, each at least one id long."""
    ends = np.cumsum(sizes)
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    symbols, rules, lengths = compress(ids, last, base)
    each = np.where(symbols < base, 1, np.concatenate([lengths, [0]])[np.maximum(symbols - base, -1)])
    places = (np.cumsum(each) - each)[::STRIDE]
    kind = "<u2" if symbols.max(initial=0) < 1 << 16 else "<u4"
    parts = [
        HEADER.pack(MAGIC, VERSION, int(kind[-1]), base, STRIDE, len(doc_ids), len(rules), len(places), len(symbols)),
        np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is not None for d in doc_ids], "u1"), sizes.astype("<u4"),
        rules.astype("<u4"), lengths.astype("<u4"), places.astype("<i8"), symbols.astype(kind)]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class Shard:
    """A shard's parts, read from its bytes."""

    def __init__(self, data: bytes):
        magic, version, width, self.base, self.stride, docs, rules, places, symbols = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of token ids of this version")
        at = HEADER.size

        def read(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        ids, there = read("<i8", docs), read("u1", docs)
        self.doc_ids = [i if t else None for i, t in zip(ids.tolist(), there.tolist())]
        self.sizes = read("<u4", docs).astype(np.int64)
        self.rules = read("<u4", 2 * rules).astype(np.int64).reshape(rules, 2)
        self.lengths = read("<u4", rules).astype(np.int64)
        self.places = read("<i8", places)
        self.symbols = read(f"<u{width}", symbols)

    def all_ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.base)

    def range(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end, from the symbols that hold them alone."""
        end = min(end, int(self.sizes.sum()))
        if start >= end:
            return np.empty(0, "<u4")
        first = int(np.searchsorted(self.places, start, side="right")) - 1
        behind = int(np.searchsorted(self.places, end, side="left"))
        symbols = self.symbols[first * self.stride:behind * self.stride].astype(np.int64)
        each = np.where(symbols < self.base, 1, np.concatenate([self.lengths, [0]])[np.maximum(symbols - self.base, -1)])
        ends = self.places[first] + np.cumsum(each)
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, end, side="left") + 1
        skipped = start - int(ends[a] - each[a])
        return expand(symbols[a:b], self.rules, self.base)[skipped:skipped + end - start]

    def document(self, number: int) -> np.ndarray:
        """The ids of the document of that number in the shard."""
        start = int(self.sizes[:number].sum())
        return self.range(start, start + int(self.sizes[number]))
