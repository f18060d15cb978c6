"""Best-fit packing by a configuration linear program over the length histogram.

Documents are tokenized once and cut into pieces; what is packed is only the histogram of piece
lengths, which has at most ``capacity`` entries however many documents there are. A configuration is
a multiset of lengths that fits one sequence. The covering program (as few configurations as
possible, every length covered as often as it occurs) is solved by multiplicative weights: lengths
that lag behind gain weight, and a knapsack dynamic program prices the best configurations. The
solution is rounded down, and what is left goes by best fit, longest first. Best fit takes runs of
equal pieces and runs of equal rooms, so the driver's work is bounded by the histogram, not by the
number of pieces, also where lengths never add up to ``capacity``.

Pieces then find their place by their rank within their length. Ranks come from counts per stored
partition and length, so a length with a third of all pieces is never gathered.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gradeframe.llm.common import checkpointed, read_table, tokenizer_path
from gradeframe.llm.pieces import PieceIds, cached, parts_of

CAPACITY = 2_048
ROUNDS, STEP, SERVED = 400, 0.5, 256
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                          ("length", pa.int64()), ("ids_crc32", pa.int64())])
END_OF_DOCUMENT = b"\0\0\0\0"  # token id 0


def cut_into_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, with the checksum of their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cached((path, "ids"), lambda: PieceIds.of(path))
        for batch in batches:
            for at, text in parts_of(batch.column(1)):
                found, ends = cache.encoded(text)
                found, ends = memoryview(found.astype("<u4").tobytes()), (4 * ends).tolist()
                rows = []
                for doc_id, a, b in zip(batch.column(0).slice(at, len(text)).to_pylist(), ends, ends[1:]):
                    length = (b - a) // 4 + 1
                    for number, start in enumerate(range(0, length, capacity)):
                        size = min(capacity, length - start)
                        last = start + size == length
                        crc = zlib.crc32(found[a + 4 * start:a + 4 * (start + size - last)])
                        rows.append((doc_id, number, start, size, zlib.crc32(END_OF_DOCUMENT, crc) if last else crc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES_ARROW)], schema=PIECES_ARROW)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECES)


def priced(value: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: for every room the index of a size to take first, or -1 to leave a token free."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fits[room]:
            gains = best[room - sizes[:k]] + value[:k]
            at = int(gains.argmax())
            if gains[at] > best[room]:
                best[room], taken[room] = gains[at], at
    return taken


def configuration(first: int, taken: np.ndarray, sizes: np.ndarray, capacity: int) -> dict[int, int]:
    """The best configuration with the size ``first``: indices of sizes and how often to take each."""
    chosen, room = {first: 1}, capacity - int(sizes[first])
    while room > 0:
        at = int(taken[room])
        if at < 0:
            room -= 1
        else:
            chosen[at] = chosen.get(at, 0) + 1
            room -= int(sizes[at])
    return chosen


def configuration_program(counts: np.ndarray, sizes: np.ndarray, capacity: int,
                          rounds: int = ROUNDS, step: float = STEP) -> list[tuple[dict[int, int], float]]:
    """Configurations and how often to use each, so that every size is covered ``counts`` times.

    A round prices all rooms once against the current weights, then serves the sizes least covered so
    far with their best configurations, each until one of its sizes has gained ``step`` of its count; no
    size is served twice in a round. Weights fall with the share of a size that is covered.
    """
    covered, used = np.zeros(len(sizes)), {}
    rate = np.log(len(sizes) + 1)
    for _ in range(rounds):
        weight = np.where(covered < 1, np.exp(-rate * (covered - covered.min())), 0.0)  # no more than asked for
        taken = priced(weight / counts, sizes, capacity)
        served = np.zeros(len(sizes), bool)
        for first in np.argsort(covered, kind="stable")[:SERVED]:
            if served[first]:
                continue
            chosen = configuration(int(first), taken, sizes, capacity)
            index, times = np.fromiter(chosen, int), np.fromiter(chosen.values(), float)
            if served[index].any():
                continue
            served[index] = True
            amount = (step * counts[index] / times).min()
            covered[index] += amount * times / counts[index]
            key = tuple(sorted(chosen.items()))
            used[key] = used.get(key, 0.0) + amount
        if covered.min() >= 1:
            break
    return [(dict(key), amount) for key, amount in used.items()]


def best_fit(lengths: Iterable[int], capacity: int) -> list[list[int]]:
    """Sequences of lengths: each length, longest first, goes where the least room is left.

    One piece at a time, for small inputs; ``fill_rooms`` gives as many sequences from runs.
    """
    rooms, sequences = [], []
    for length in sorted(lengths, reverse=True):
        at = bisect_left(rooms, (length, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            room, number = capacity, len(sequences)
            sequences.append([])
        sequences[number].append(length)
        if room > length:
            insort(rooms, (room - length, number))
    return sequences


def fill_rooms(pieces: dict[int, int], opened: Iterable[tuple[dict[int, int], int]],
               capacity: int) -> list[tuple[dict[int, int], int]]:
    """All sequences (pieces of each length, how many such sequences) after best fit, longest first.

    ``pieces`` counts each length, ``opened`` are sequences that have room already. A piece goes where the
    least room is left, and what it leaves is the least room for the next of its length, so a run of equal
    rooms takes equal pieces at once. A length splits at most one run, in three.
    """
    runs: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []

    def keep(room: int, chosen: dict[int, int], times: int) -> None:
        if room not in runs:
            runs[room] = []
            insort(rooms, room)
        runs[room].append((chosen, times))

    for chosen, times in opened:
        keep(capacity - sum(length * n for length, n in chosen.items()), chosen, times)
    for length, n in sorted(pieces.items(), reverse=True):
        while n > 0:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                chosen, times = runs[room].pop()
                if not runs[room]:
                    del runs[rooms.pop(at)]
            else:
                room, chosen, times = capacity, {}, -(-n // (capacity // length))
            each = room // length
            whole = min(times, n // each)
            some = n - whole * each if whole < times else 0  # fewer than ``each``, in one sequence
            for own, taken in ((whole, each), (int(some > 0), some), (times - whole - (some > 0), 0)):
                if own > 0:
                    keep(room - taken * length, chosen | {length: taken} if taken else chosen, own)
            n -= whole * each + some
    return [run for same in runs.values() for run in same]


def sequences_of(histogram: dict[int, int], program: list[tuple[dict[int, int], float]], sizes: np.ndarray,
                 capacity: int, exact: bool) -> list[tuple[dict[int, int], int]]:
    """Sequences by the rounded program, only its configurations without a free token if ``exact``, and best fit."""
    left, opened = dict(histogram), []
    for chosen, amount in sorted(program, key=lambda x: -x[1]):
        lengths = {int(sizes[i]): n for i, n in sorted(chosen.items(), reverse=True)}
        if exact and sum(length * n for length, n in lengths.items()) < capacity:
            continue
        times = min(int(amount + 1e-6), *(left[length] // n for length, n in lengths.items()))
        if times > 0:
            opened.append((lengths, times))
            for length, n in lengths.items():
                left[length] -= n * times
    return fill_rooms(left, opened, capacity)


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For every length, rows (first rank, first sequence, pieces in a sequence, first offset).

    A rank r of the length belongs to the last row whose first rank is not above r; with d = r - first
    rank its sequence is first sequence + d // pieces and its offset first offset + d % pieces * length.
    The program's solution is rounded down and best fit packs the others, longest first, also into the rooms
    that configurations leave. That is done with the configurations that leave no token free and with all;
    the plan is the one with the fewest sequences.
    """
    counts = {length: n for length, n in sorted(histogram.items()) if n > 0}
    used: dict[int, int] = dict.fromkeys(counts, 0)
    rows: dict[int, list[tuple[int, int, int, int]]] = {length: [] for length in counts}
    sequences = 0
    plan: list[tuple[dict[int, int], int]] = []
    if counts:
        sizes = np.array(list(counts))
        program = configuration_program(np.array(list(counts.values()), float), sizes, capacity)
        plan = min((sequences_of(counts, program, sizes, capacity, exact) for exact in (True, False)),
                   key=lambda found: sum(times for _, times in found))
    for lengths, times in plan:
        offset = 0
        for length, n in lengths.items():
            rows[length].append((used[length], sequences, n, offset))
            used[length] += n * times
            offset += n * length
        sequences += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text (null: empty) without special tokens, then id 0, so an
    empty document is one piece of one token. Only documents longer than ``capacity`` are cut. Rows
    that repeat are documents of their own. Other columns are ignored; an empty table gives an
    empty result.
    """
    pieces = checkpointed(
        cut_into_pieces(docs, path or tokenizer_path(), capacity).withColumn("part", F.spark_partition_id())
    )
    counts = pieces.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    # The histogram has at most ``capacity`` rows.
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = plan_sequences(histogram, capacity)

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        values, starts = np.unique(length[order], return_index=True)
        for value, own in zip(values, np.split(order, starts[1:])):
            rows = plan[int(value)]
            row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
            ahead = rank[own] - row[:, 0]
            sequence[own] = row[:, 1] + ahead // row[:, 2]
            offset[own] = row[:, 3] + ahead % row[:, 2] * value
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    within = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("own", F.row_number().over(within) - 1).join(firsts, ["part", "length"])
        .withColumn("p", place(F.col("length"), F.col("first") + F.col("own")))
    )
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read_table(spark, folder, "documents"))
