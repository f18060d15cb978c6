"""Token ids as files: shards of ids under a Re-Pair grammar, in ascending doc_id order.

Texts are dealt by ranges of doc_id and sorted, encoded where they arrive, and written as shards of about
``SHARD_IDS`` ids, one row each of a Parquet table (``grammar`` has the bytes). Spark's writer commits the tables, so
a lost executor leaves no half-written shard, and any store that Spark reads will do. A shard names its write
task, its number in the task and how many ids the task wrote before; with the totals of the tasks, one
row each, every document's place among all ids is known without another sort.

Ranges are cut by doc_id, a hash of the text, and the row, so rows that share a doc_id spread.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gradeframe.llm.common import read_table, shared_folder, tokenizer_path
from gradeframe.llm.grammar import Shard, write_shard
from gradeframe.llm.pieces import PieceIds, cached, parts_of

BYTE_TOKENIZER, END_ID = "byte_bpe_50k.json", 2
SHARD_IDS = 1 << 20
SHARDS = "part int, shard int, first bigint, n_docs int, n_ids bigint, payload binary"
SHARDS_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_docs", pa.int32()),
                          ("n_ids", pa.int64()), ("payload", pa.binary())])
DOCUMENTS = "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
DOCUMENTS_ARROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                             ("ids_crc32", pa.int64())])


def encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    """Shards of the documents (doc_id, text) of a task, in their order."""
    from pyspark import TaskContext

    part, shard, first = TaskContext.get().partitionId(), 0, 0
    cache = cached((path, "ids"), lambda: PieceIds.of(path))
    base = max(cache.tokenizer.get_vocab_size(), end_id + 1)
    held: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []
    count = 0

    def flushed() -> pa.RecordBatch:
        nonlocal shard, first, count
        doc_ids, sizes, ids = zip(*held)
        docs = [d for own in doc_ids for d in own]
        row = (part, shard, first, len(docs), count, write_shard(docs, np.concatenate(sizes), np.concatenate(ids), base))
        shard, first, count = shard + 1, first + count, 0
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, SHARDS_ARROW)], schema=SHARDS_ARROW)

    for batch in batches:
        for at, text in parts_of(batch.column(1)):
            doc_ids = batch.column(0).slice(at, len(text)).to_pylist()
            ids, ends = cache.encoded(text)
            ids = np.insert(ids, ends[1:], end_id)
            ends = ends + np.arange(len(ends))
            a = 0
            while a < len(doc_ids):
                b = int(np.searchsorted(ends, ends[a] + shard_ids - count))
                b = min(max(b, a + 1), len(doc_ids))
                held.append((doc_ids[a:b], np.diff(ends[a:b + 1]), ids[ends[a]:ends[b]]))
                count += int(ends[b] - ends[a])
                a = b
                if count >= shard_ids:
                    yield flushed()
    if held:
        yield flushed()


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
              shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of every whole text, each followed by ``end_id``, as a table of shards at ``path``.

    Documents come in ascending order of doc_id, null last; rows that share a doc_id in the order of a hash
    of their texts. Null texts are empty: their end id alone. Special strings inside texts are handled as the
    library does by default. Repeated rows are documents of their own; other columns are ignored; an
    empty table gives an empty table of shards.
    """
    tokenizer = tokenizer or tokenizer_path(BYTE_TOKENIZER)
    doc_id = F.col("doc_id").cast("bigint")
    named = docs.select(doc_id.alias("doc_id"), "text", F.xxhash64("text").alias("hash"),
                        F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_last("doc_id"), F.col("hash"), F.col("row")]
    ordered = named.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(
        lambda batches: encode(batches, tokenizer, end_id, shard_ids), SHARDS).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def read_ids(shards: DataFrame) -> DataFrame:
    """doc_id and ids of every document, from the shards alone."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                shard = Shard(payload.as_buffer())
                offsets = np.concatenate([[0], np.cumsum(shard.sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.doc_ids, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(shard.all_ids().astype(np.int32)))], ["doc_id", "ids"])

    return shards.select("payload").mapInArrow(decode, "doc_id bigint, ids array<int>")


def describe(shards: DataFrame) -> DataFrame:
    """One row per document, from the shards alone: doc_id, start, n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                shard = Shard(payload.as_buffer())
                ids = memoryview(shard.all_ids().tobytes())
                ends = np.concatenate([[0], np.cumsum(shard.sizes)])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((4 * ends).tolist(), (4 * ends[1:]).tolist())]
                columns = (np.full(len(crc), part), shard.doc_ids, first + ends[:-1], shard.sizes, crc)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, DOCUMENTS_ARROW)],
                                                 schema=DOCUMENTS_ARROW)

    # One row per write task, as many as a shuffle has partitions; so they are broadcast.
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    documents = shards.select("part", "first", "payload").mapInArrow(decode, DOCUMENTS)
    return documents.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(read_table(spark, folder, "documents"), path)
    return describe(read_shards(spark, path))
