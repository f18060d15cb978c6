"""Removal of repeated passages: a hash-compared suffix sort, dealt by content.

A byte goes when a string of ``LENGTH`` bytes around it also starts earlier in the corpus. Sorting all
suffixes in one place would move the corpus many times, so suffixes are dealt first:

1. Anchors. Of every LENGTH consecutive bytes the least of their ``GRAM``-byte hashes marks an anchor, so
   equal strings share an anchor at the same place; about one byte in 35 is one. Prefix polynomial hashes
   give all gram hashes of a text in a few array operations.
2. An anchor goes out as two hashes: of its gram and of its neighbourhood (all bytes that share a string
   with it), 128 independent bits. Where both agree, the neighbourhoods are the same and all but the
   first are covered. Each task combines its own anchors before the shuffle, so passages of
   thousands of documents are a row per task.
3. Where grams agree and neighbourhoods differ, the first neighbourhood of each kind is fetched, and the
   suffixes that start at the same place before the anchor are sorted: a mergesort of all buckets at
   once, whose comparisons find the common extension by binary search over prefix hashes. Neighbours
   that agree in LENGTH bytes are verified byte by byte; after a collision the bucket is sorted by bytes.
   A gram with very many neighbourhoods is dealt again by the bytes before and by the bytes after it: a
   string holds at least HALF of the one or of the other.
4. Groups that are large even then are dealt once more, by 128 bits of each whole string. Each task combines
   its own strings first, as it does with anchors, so a string of any number of documents is a row per task.

Texts are shuffled once, by document, for the last two steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.llm.common import as_bytes, read_table, slices, stored
from gradeframe.llm.components import join_dealt
from gradeframe.llm.near_join import groups_of, mixed

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # bytes of a string on either side of its anchor
HALF = REACH // 2
SEGMENT = 1 << 20  # bytes hashed at a time
FLUSH = 500_000  # anchors combined at a time
MANY = 2_000  # neighbourhoods that are sorted together
VERIFIED = 1 << 15  # strings compared by bytes at a time
BASE = np.uint64(0x9E3779B97F4A7C15)
LAST = (1 << 63) - 1  # orders null doc_ids last

PLACES = "key bigint, kind bigint, did bigint, ver bigint, start int, end int, lead int"
PLACES_ARROW = pa.schema([("key", pa.int64()), ("kind", pa.int64()), ("did", pa.int64()), ("ver", pa.int64()),
                          ("start", pa.int32()), ("end", pa.int32()), ("lead", pa.int32())])
BYTES = "key bigint, did bigint, ver bigint, start int, lead int, bytes binary"
SPANS = "did bigint, ver bigint, start int, end int"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SEGMENT + LENGTH)
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            cls.up, cls.down = (np.multiply.accumulate(np.concatenate(
                [np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, inverse))
        return cls.up[:n], cls.down[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = base^i * hash of data[i:j], modulo 2^64."""
    up, _ = Powers.of(len(data))
    hashes = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=hashes[1:])
    return hashes


def sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` (minimum or maximum) of every ``width`` consecutive values, by doubling."""
    done = 1
    while 2 * done <= width:
        values = least(values[:-done], values[done:])
        done *= 2
    return least(values[:len(values) - (width - done)], values[width - done:]) if done < width else values


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of ``data``."""
    places, grams = [], []
    window = REACH + 1
    for at in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT):
        part = np.frombuffer(data, np.uint8)[at:at + SEGMENT + LENGTH - 1]
        hashes = prefix_hashes(part)
        _, down = Powers.of(len(part) - GRAM + 1)
        gram = mixed((hashes[GRAM:] - hashes[:-GRAM]) * down)
        short = (gram >> np.uint64(32)).astype(np.uint32)
        least = sliding(short, window, np.minimum)
        # A gram is an anchor if it is the least of some string around it.
        around = np.concatenate([np.zeros(window - 1, np.uint32), least, np.zeros(window - 1, np.uint32)])
        found = np.flatnonzero(sliding(around, window, np.maximum) == short)
        places.append(found + at)
        grams.append(gram[found])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, grams = np.concatenate(places), np.concatenate(grams)
    if len(data) > SEGMENT:
        places, own = np.unique(places, return_index=True)
        grams = grams[own]
    return places, grams


def merged(start: np.ndarray, end: np.ndarray, *owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of the spans of every owner, as start, end and the owner's columns."""
    order = np.lexsort((start, *owner))
    start, end, owner = start[order], end[order], [c[order] for c in owner]
    if not len(start):
        return start, end, *owner
    new = np.ones(len(start), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in owner], axis=0) if owner else False
    group = np.cumsum(new) - 1
    shift = group * (int(end.max()) + 1)  # keeps owners apart in one running maximum
    reach = np.maximum.accumulate(end + shift)
    new[1:] |= (start + shift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return start[first], (reach - shift)[last], *[c[first] for c in owner]


def split_kinds(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of anchors sorted by key, kind, did, ver, start: which are the first of their kind, which repeat it elsewhere."""
    key, kind, *place = columns
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    # The same place again comes from a repeated row and repeats nothing.
    again = ~first & np.any([c != c[head] for c in place[:3]], axis=0)
    return first, again


def combined(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Places (key, kind, did, ver, start, end, lead) as the firsts of their kind and the spans that others cover.

    Spans are merged per document and have lead -1.
    """
    order = np.lexsort(columns[4::-1])
    columns = [c[order] for c in columns]
    first, again = split_kinds(columns[:5])
    _, _, did, ver, start, end, _ = (c[again] for c in columns)
    start, end, ver, did = merged(start.astype(np.int64), end.astype(np.int64), ver, did)
    key = mixed(did.view(np.uint64) ^ ver.view(np.uint64)).view(np.int64)  # dealt evenly
    return [c[first] for c in columns], [key, np.zeros_like(did), did, ver, start, end, np.full(len(did), -1)]


def place_batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PLACES_ARROW)], schema=PLACES_ARROW)


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First anchors of their kind within the task, and the spans that others cover."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    for batch in slices(batches, 1_000):
        for did, ver, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
            place, gram = anchors(data)
            if not len(place):
                continue
            lead = np.minimum(place, REACH)
            start, end = place - lead, np.minimum(place + LENGTH, len(data))
            kind = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b], c) for a, b, c in zip(
                start.tolist(), end.tolist(), lead.tolist())), np.uint64, len(place))
            held.append((gram.view(np.int64), kind.view(np.int64), np.full(len(place), did), np.full(len(place), ver),
                         start, end, lead))
            count += len(place)
            if count >= FLUSH:
                yield from map(place_batch, combined([np.concatenate(c) for c in zip(*held)]))
                held, count = [], 0
    if held:
        yield from map(place_batch, combined([np.concatenate(c) for c in zip(*held)]))


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered spans (lead -1) and the neighbourhoods to compare, from places sorted by key.

    ``kind`` of a neighbourhood becomes 1 if its gram has more than MANY of them.
    """
    for table in groups_of(batches, (0,)):
        columns = [table.column(i).to_numpy() for i in range(7)]
        done = columns[6] < 0
        spans = [c[done] for c in columns]
        columns = [c[~done] for c in columns]
        order = np.lexsort(columns[4::-1])
        columns = [c[order] for c in columns]
        first, again = split_kinds(columns[:5])
        covered = [np.concatenate([s, c[again]]) for s, c in zip(spans, columns)]
        covered[6] = np.full(len(covered[0]), -1)
        firsts = [c[first] for c in columns]
        _, group, sizes = np.unique(firsts[0], return_inverse=True, return_counts=True)
        sizes = sizes[group]
        several = [c[sizes > 1] for c in firsts]
        several[1] = (sizes[sizes > 1] > MANY).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c), f.type) for c, f in zip(zip(covered, several), PLACES_ARROW)], schema=PLACES_ARROW)


def halves(place: dict, data: bytes) -> Iterator[tuple[int, int, int]]:
    """Key, start and end of both parts of a neighbourhood: its strings with HALF before the gram, and HALF behind."""
    at = place["start"] + place["lead"]
    signed = lambda part, side: int.from_bytes(
        xxhash.xxh3_64_digest(part, place["key"] & (1 << 64) - 1 ^ side), "big", signed=True)
    if place["lead"] >= HALF:
        end = min(place["end"], at + LENGTH - HALF)
        yield signed(data[at - HALF:at + GRAM], 1), place["start"], end
    if place["end"] >= at + GRAM + HALF:
        start = max(place["start"], at - HALF)
        yield signed(data[at:at + GRAM + HALF], 2), start, place["end"]


def fetch(batches: Iterator[pa.RecordBatch], frequent: bool) -> Iterator[pa.RecordBatch]:
    """The bytes of neighbourhoods; those of very frequent grams in two parts, dealt by more bytes than the gram."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    for batch in slices(batches, 200):
        rows = []
        for did, ver, data, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                          as_bytes(batch.column(2)), batch.column(3).to_pylist()):
            for place in wanted or ():
                if bool(place["kind"]) != frequent:
                    continue
                at = place["start"] + place["lead"]
                parts = halves(place, data) if place["kind"] else [(place["key"], place["start"], place["end"])]
                for key, start, end in parts:
                    if end - start >= LENGTH:
                        rows.append((key, did, ver, start, at - start, data[start:end]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                             ["key", "did", "ver", "start", "lead", "bytes"])


def count_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the parts of very frequent grams, and how many neighbourhoods of the batch have each."""
    for batch in slices(batches, 1_000):
        counts: dict[int, int] = {}
        for data, wanted in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
            for place in wanted:
                for key, start, end in halves(place, data) if place["kind"] else ():
                    if end - start >= LENGTH:
                        counts[key] = counts.get(key, 0) + 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())],
                                             ["key", "n"])


def whole_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of neighbourhoods as a place: firsts within the task, and the spans that others cover."""
    held: list[tuple[int, ...]] = []

    def flushed() -> Iterator[pa.RecordBatch]:
        columns = [np.array(c, np.int64) for c in zip(*held)]
        held.clear()
        yield from map(place_batch, combined([*columns, columns[4] + LENGTH, np.zeros_like(columns[4])]))

    for batch in slices(batches, 1_000):
        for did, ver, start, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for at in range(len(data) - LENGTH + 1):
                digest = xxhash.xxh3_128_digest(data[at:at + LENGTH])
                held.append((int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True),
                             did, ver, start + at))
        if len(held) >= FLUSH:
            yield from flushed()
    if held:
        yield from flushed()


class Suffixes:
    """Suffixes of a buffer, compared in their first LENGTH bytes through prefix hashes."""

    def __init__(self, buffer: np.ndarray):
        self.buffer, self.hashes = buffer, prefix_hashes(buffer)
        self.powers, _ = Powers.of(len(buffer) + 1)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, at most LENGTH, by binary search."""
        common = np.zeros(len(a), np.int64)
        base_a, base_b = self.powers[a], self.powers[b]
        step = 1 << (LENGTH.bit_length() - 1)
        while step:
            longer = common + step
            fits = np.minimum(longer, LENGTH)
            same = (self.hashes[a + fits] - self.hashes[a]) * base_b == (self.hashes[b + fits] - self.hashes[b]) * base_a
            common = np.where(same & (longer <= LENGTH), longer, common)
            step >>= 1
        return common

    def less(self, a: np.ndarray, b: np.ndarray, rank_a: np.ndarray, rank_b: np.ndarray) -> np.ndarray:
        common = self.extension(a, b)
        equal = common >= LENGTH
        inside = np.minimum(common, LENGTH - 1)
        return np.where(equal, rank_a < rank_b, self.buffer[a + inside] < self.buffer[b + inside])

    def strings(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the LENGTH bytes at each place."""
        _, down = Powers.of(len(self.buffer) + 1)
        return mixed((self.hashes[at + LENGTH] - self.hashes[at]) * down[at])

    def same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        strings = np.lib.stride_tricks.sliding_window_view(self.buffer, LENGTH)
        return np.concatenate([np.empty(0, bool), *(
            (strings[a[i:i + VERIFIED]] == strings[b[i:i + VERIFIED]]).all(axis=1) for i in range(0, len(a), VERIFIED))])


def merge_sort(suffixes: Suffixes, at: np.ndarray, rank: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Order of the suffixes ``at`` within their buckets, which are contiguous; equal ones by rank.

    Bottom-up: in each pass all runs of all buckets are merged with their neighbours at once. An
    element's new place is its place in its own run plus how many of the other run come before it,
    found by binary search.
    """
    order = np.arange(len(at))
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(starts, len(at)))
    first = np.repeat(starts, sizes)
    size = np.repeat(sizes, sizes)
    inside = np.arange(len(at)) - first
    width = 1
    while width < sizes.max(initial=0):
        run = inside // width
        left = run % 2 == 0
        other = np.where(left, run + 1, run - 1) * width
        count = np.clip(size - other, 0, width)
        low, high = np.zeros(len(at), np.int64), count.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            mine, theirs = order[open_], order[first[open_] + other[open_] + middle]
            before = suffixes.less(at[theirs], at[mine], rank[theirs], rank[mine])
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        pair = run // 2 * 2 * width
        place = first + pair + (inside - run * width) + low
        moved = np.empty_like(order)
        moved[place] = order
        order = moved
        width *= 2
    return order


def met_again(suffixes: Suffixes, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Which suffixes share the hash of their first LENGTH bytes with another one of their bucket.

    Equal strings have equal hashes, so the others repeat nothing and need no sorting.
    """
    key = mixed(suffixes.strings(at) ^ mixed(bucket.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    found = np.zeros(len(at), bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    return found


def repeated_strings(group: np.ndarray, did: np.ndarray, ver: np.ndarray, start: np.ndarray, lead: np.ndarray,
                     texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last place of the strings of neighbourhoods that an earlier one of their group has too."""
    sizes = np.array([len(t) for t in texts])
    offset = np.cumsum(sizes) - sizes
    suffixes = Suffixes(np.frombuffer(b"".join(texts), np.uint8))
    count = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(texts)), count)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = offset[row] + inside
    before = (lead[row] - inside).astype(np.int64)  # how far the string starts before the anchor
    bucket = group[row].astype(np.int64) * (2 * LENGTH) + before
    met = met_again(suffixes, at, bucket)
    row, inside, at, bucket = row[met], inside[met], at[met], bucket[met]
    by_place = np.lexsort((start, ver, did))
    rank = np.empty(len(texts), np.int64)
    rank[by_place] = np.arange(len(texts))
    dealt = np.argsort(bucket, kind="stable")
    row, inside, at, bucket = row[dealt], inside[dealt], at[dealt], bucket[dealt]
    order = merge_sort(suffixes, at, rank[row], bucket)
    row, inside, at = row[order], inside[order], at[order]
    same = bucket[1:] == bucket[:-1]
    equal = np.zeros(len(row), bool)
    equal[1:][same] = suffixes.extension(at[1:][same], at[:-1][same]) >= LENGTH
    checked = np.flatnonzero(equal)
    if not suffixes.same_bytes(at[checked], at[checked - 1]).all():  # a hash collision: sort by the bytes
        strings = [bytes(suffixes.buffer[a:a + LENGTH]) for a in at]
        order = np.array(sorted(range(len(at)), key=lambda i: (bucket[i], strings[i], rank[row[i]])))
        row, inside, strings = row[order], inside[order], [strings[i] for i in order]
        equal[1:] = [b and x == y for b, x, y in zip(same, strings[1:], strings)]
    head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(row))))
    places = [c[row] for c in (did, ver, start)]
    later = equal & np.any([c != c[head] for c in places], axis=0)
    rows, own = np.unique(row[later], return_inverse=True)
    least, most = np.full(len(rows), 1 << 40), np.zeros(len(rows), np.int64)
    np.minimum.at(least, own, inside[later])
    np.maximum.at(most, own, inside[later])
    return rows, least, most


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans covered by strings that the neighbourhoods of a group share; rows come sorted by key."""
    for table in groups_of(slices(batches, MANY), (0,)):
        _, group, sizes = np.unique(table.column(0).to_numpy(), return_inverse=True, return_counts=True)
        several = sizes[group] > 1
        if not several.any():
            continue
        did, ver, start, lead = (table.column(i).to_numpy()[several] for i in range(1, 5))
        texts = table.column(5).filter(pa.array(several)).to_pylist()
        # All strings of a neighbourhood hold its anchor, so those that repeat cover one span.
        rows, least, most = repeated_strings(group[several], did, ver, start, lead, texts)
        yield pa.RecordBatch.from_arrays([
            pa.array(did[rows]), pa.array(ver[rows]), pa.array(start[rows] + least, pa.int32()),
            pa.array(start[rows] + most + LENGTH, pa.int32())], ["did", "ver", "start", "end"])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text."""
    for batch in slices(batches, 200):
        rows = []
        for doc_id, data, spans in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
            start, end = (np.array([s[k] for s in spans or ()], np.int64) for k in ("start", "end"))
            start, end = merged(start, end)
            kept, last = hashlib.sha256(), 0
            for a, b in zip(start.tolist(), end.tolist()):
                kept.update(data[last:a])
                last = b
            kept.update(data[last:])
            rows.append((doc_id, len(data), int((end - start).sum()), len(start), kept.hexdigest()))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def strings_to_compare(named: DataFrame, settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbourhoods with their bytes: in groups of at most MANY, and those of larger groups.

    Only parts of frequent grams can be in a larger group, so only they meet the counts of their keys.
    """
    wanted = settled.where("lead >= 0").groupBy("did", "ver").agg(
        F.collect_list(F.struct("key", "kind", "start", "end", "lead")).alias("wanted"))
    # All joins keep every document, so they read the same shuffled texts.
    joined = named.join(wanted.hint("shuffle_merge"), ["did", "ver"], "left").where("wanted is not null")
    frequent = joined.where(F.exists("wanted", lambda place: place["kind"] == 1))
    large = frequent.select("text", "wanted").mapInArrow(count_halves, "key bigint, n bigint").groupBy("key").agg(
        F.sum("n").alias("n")).where(F.col("n") > MANY).select("key")
    fields = ["did", "ver", "text", "wanted"]
    few = joined.select(*fields).mapInArrow(lambda batches: fetch(batches, False), BYTES)
    parts = frequent.select(*fields).mapInArrow(lambda batches: fetch(batches, True), BYTES)
    # Dealt anew on both sides, so that the adaptive skew join may split the parts of one key.
    small, more = (join_dealt(parts, large, "key", how) for how in ("left_anti", "left_semi"))
    return few.unionByName(small.select(*few.columns)), more


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null is empty; texts below LENGTH bytes lose nothing. Earlier means a smaller
    doc_id, or an earlier start in the same document; a null doc_id comes last. Rows that share a doc_id
    are taken in the order of a hash of their texts; equal rows are the same document and give the same
    result. Other columns are ignored; an empty table gives an empty result.
    """
    did = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    text = F.coalesce("text", F.lit(""))
    named = docs.select(did.alias("did"), F.xxhash64(text).alias("ver"), F.col("doc_id").cast("bigint"), text.alias("text"))
    places = named.select("did", "ver", "text").mapInArrow(find_anchors, PLACES)
    settled = stored(
        places.repartition("key").sortWithinPartitions("key").mapInArrow(settle, PLACES))
    small, large = strings_to_compare(named, settled)
    shared = small.repartition("key").sortWithinPartitions("key").mapInArrow(compare, SPANS)
    # Strings whose first 64 bits agree and whose others differ come with lead 0 and repeat nothing.
    whole = large.select("did", "ver", "start", "bytes").mapInArrow(whole_strings, PLACES).repartition(
        "key").sortWithinPartitions("key").mapInArrow(settle, PLACES).where("lead < 0").select("did", "ver", "start", "end")
    shared = shared.unionByName(whole)
    spans = settled.where("lead < 0").select("did", "ver", "start", "end").unionByName(shared).groupBy("did", "ver").agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))
    return named.join(spans.hint("shuffle_merge"), ["did", "ver"], "left").select("doc_id", "text", "spans").mapInArrow(
        cut, RESULT)


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(read_table(spark, folder, "documents"))
