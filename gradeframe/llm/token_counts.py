"""Token counts: a two-tier lookup on the map side.

Texts are cut into pieces where the tokenizer never joins (``pieces``), so a count is the sum over the pieces.
Piece lengths come from a broadcast table of the corpus's most frequent pieces (at most ``FREQUENT`` entries)
and otherwise from a worker's own cache, which asks the library on a miss. No piece is shuffled.

The table comes from all documents: every task keeps a summary of bounded size (Misra-Gries: of more than
``SUMMARY`` counters the next largest count is taken off all), and one aggregation merges the summaries. The
table decides only how often the library is asked, never a count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.llm.common import read_table, tokenizer_path
from gradeframe.llm.pieces import Growing, PieceIds, cached, load_tokenizer, parts_of, pieces_of

FREQUENT, SUMMARY = 32_768, 16_384
LONGEST = 64  # bytes of a piece that the table may hold
TOKEN_LIMIT = 2_048
ALWAYS = 1 << 60  # more often than any piece is met


class PieceCounts(PieceIds):
    """Number of ids of every piece; those of the table stay."""

    def __init__(self, *args, frequent: dict[bytes, int] | None = None, **options):
        super().__init__(*args, **options)
        self.stays = len(frequent or {})
        self.index = {piece: number for number, piece in enumerate(frequent or {})}
        self.count = Growing(np.int64, list((frequent or {}).values()))
        self.met = Growing(np.int64, np.full(self.stays, ALWAYS))

    def keep(self, stay: np.ndarray) -> None:
        self.count = Growing(np.int64, self.count.values[stay])
        self.met = Growing(np.int64, np.where(stay < self.stays, ALWAYS, 0))

    def add(self, found: list[list[int]]) -> None:
        self.count.add(np.fromiter(map(len, found), np.int64, len(found)))
        self.met.add(np.zeros(len(found)))

    def counted(self, text: pa.Array) -> np.ndarray:
        """Number of ids of every text."""
        pieces, first = pieces_of(text, self.rule, self.lower, self.added)
        number = self.known(pieces)
        ends = np.concatenate([[0], np.cumsum(self.count.values[number])])
        return np.diff(ends[first])


class Summary:
    """Counters of the most frequent pieces, at most ``most`` of them; each is too low by at most ``lost``."""

    def __init__(self, most: int = SUMMARY):
        self.most, self.lost, self.counts = most, 0, {}

    def cut(self, counts: np.ndarray) -> tuple[np.ndarray, int]:
        """Which counters stay, and what is taken off them."""
        if len(counts) <= self.most:
            return np.arange(len(counts)), 0
        off = int(np.partition(counts, len(counts) - self.most - 1)[len(counts) - self.most - 1])
        return np.flatnonzero(counts > off), off

    def add(self, pieces: pa.Array) -> None:
        seen = pieces.value_counts()
        counts = seen.field("counts").to_numpy()
        stay, off = self.cut(counts)
        self.lost += off
        for piece, n in zip(seen.field("values").take(pa.array(stay)).to_pylist(), (counts[stay] - off).tolist()):
            self.counts[piece] = self.counts.get(piece, 0) + n
        names, counts = list(self.counts), np.fromiter(self.counts.values(), np.int64, len(self.counts))
        stay, off = self.cut(counts)
        if off:
            self.lost += off
            self.counts = {names[i]: n for i, n in zip(stay.tolist(), (counts[stay] - off).tolist())}


def summaries(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The frequent pieces of a task and their counts."""
    cache, summary = cached((path, "ids"), lambda: PieceIds.of(path)), Summary()
    for batch in batches:
        for _, text in parts_of(batch.column(0)):
            pieces, _ = pieces_of(text, cache.rule, cache.lower, cache.added)
            short = pc.less_equal(pc.binary_length(pieces), LONGEST)
            summary.add(pieces.filter(short))
    if summary.counts:
        yield pa.RecordBatch.from_arrays([pa.array(summary.counts.keys(), pa.binary()),
                                          pa.array(summary.counts.values(), pa.int64())], ["piece", "n"])


def frequent_lengths(docs: DataFrame, path: str, entries: int = FREQUENT) -> dict[bytes, int]:
    """Token counts of the most frequent pieces of all documents; at most ``entries`` of them."""
    counted = docs.select("text").mapInArrow(lambda batches: summaries(batches, path), "piece binary, n bigint")
    most = counted.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(entries)
    frequent = [bytes(row.piece) for row in most.select("piece").collect()]
    encoded = load_tokenizer(path).encode_batch_fast([p.decode("utf-8", "replace") for p in frequent], add_special_tokens=False)
    return {piece: len(e.ids) for piece, e in zip(frequent, encoded)}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the tokenizers library for the whole text, without added special tokens;
    special strings inside a text are handled as the library does by default. Null texts are empty
    (0 tokens). Repeated rows give repeated rows; other columns are ignored; an empty table gives
    an empty result.
    """
    path = path or tokenizer_path()
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))
    name = uuid.uuid4().hex  # a cache of its own for each table

    @F.arrow_udf("bigint")
    def n_tokens(text: pa.Array) -> pa.Array:
        cache = cached((path, "counts", name), lambda: PieceCounts.of(path, frequent=table.value))
        counts = [cache.counted(part) for _, part in parts_of(text)]
        return pa.array(np.concatenate(counts) if counts else np.empty(0, np.int64))

    counted = docs.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"),
        n_tokens(F.col("text")).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read_table(spark, folder, "documents"))
