"""Exact dedup: content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes says so, so equal texts are cut alike.
Every chunk becomes a short identifier (64-bit hash and length), verified by the SHA-256 of its
bytes: chunks that share hash and length but not their digest get different identifiers. Texts
are equal when their ordered identifier lists are. The text is read once, by the task that reads
its file; only digests and lists are shuffled, whatever the length of a document.

A group of copies may hold a third of all rows: groups are combined before the shuffle, and in
the join back the adaptive skew join may split the side of the documents.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gradeframe.llm.common import SPACE, as_bytes, checkpointed, keep_rows, read_table
from gradeframe.llm.components import join_dealt

LEAST_CHUNK, MOST_CHUNK, MASK = 512, 65_536, 2_047
RECIPE = T.StructType([
    T.StructField("sha", T.StringType()),
    T.StructField("chunks", T.ArrayType(T.StructType([
        T.StructField("h", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("digest", T.BinaryType())]))),
])
RECIPE_TYPE = pa.struct([
    ("sha", pa.string()),
    ("chunks", pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32()), ("digest", pa.binary())]))),
])
# A lone space stays as it is, so only other runs are matched.
LONG_SPACE = re.compile(rb"[\t-\r][ \t-\r]*| [ \t-\r]+")
GEAR = np.random.default_rng(20_240_601).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; the last one is its length. No chunk for empty data."""
    size = len(data)
    if size <= LEAST_CHUNK:
        return [size] if size else []
    rolled = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # hash of the last 2, 4, 8, 16, 32 bytes
        rolled[step:] = rolled[step:] + (rolled[:-step] << np.uint32(step))
    marks = np.flatnonzero((rolled >> np.uint32(7)) & np.uint32(MASK) == 0) + 1
    ends, last = [], 0
    while size - last > LEAST_CHUNK:
        at = np.searchsorted(marks, last + LEAST_CHUNK)
        end = int(marks[at]) if at < len(marks) else size
        end = min(end, last + MOST_CHUNK, size)
        ends.append(end)
        last = end
    if last < size:
        ends.append(size)
    return ends


def recipe_of(data: bytes) -> dict:
    data = LONG_SPACE.sub(b" ", data)
    chunks, last = [], 0
    for end in cut_points(data):
        chunk = data[last:end]
        h = xxhash.xxh3_64_intdigest(chunk)
        chunks.append({"h": h - (h >> 63 << 64), "n": len(chunk), "digest": hashlib.sha256(chunk).digest()})
        last = end
    return {"sha": hashlib.sha256(data).hexdigest(), "chunks": chunks}


@F.arrow_udf(RECIPE)
def recipe(text: pa.Array) -> pa.Array:
    return pa.array([recipe_of(data) for data in as_bytes(text)], RECIPE_TYPE)


def verified_recipes(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_sha256 and the ordered list of verified chunk identifiers."""
    read = checkpointed(
        docs.select("doc_id", recipe(F.col("text")).alias("r"))
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "r.sha", "r.chunks")
    )
    contents = read.select(F.explode("chunks").alias("c")).select("c.*").distinct()
    collided = (
        contents.groupBy("h", "n").agg(F.array_sort(F.collect_set("digest")).alias("digests"))
        .where(F.size("digests") > 1)
    )
    pieces = read.select("row", F.posexplode("chunks").alias("pos", "c")).select("row", "pos", "c.*")
    # Both sides are dealt anew, so that the adaptive skew join may split a chunk of very many documents.
    ranked = join_dealt(pieces, collided, ["h", "n"], "left").select(
        "row", "pos", "h", "n", F.coalesce(F.array_position("digests", F.col("digest")), F.lit(0)).alias("same")
    )
    lists = ranked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "h", "n", "same"))).alias("ids"))
    ids = F.coalesce(F.transform("ids", lambda x: F.struct(x.h, x.n, x.same)), F.array())
    return read.select("row", "doc_id", "sha").join(lists, "row", "left").select(
        "row", "doc_id", F.col("sha").alias("text_sha256"), ids.alias("ids")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of ASCII white space became one space; a null
    text counts as empty, and empty texts are equal to each other. Of equal texts the row with the
    smallest doc_id stays; a null doc_id comes after all others; of rows that repeat the smallest
    doc_id exactly one stays. Other columns are ignored. An empty table gives an empty result.
    """
    rows = checkpointed(verified_recipes(docs)).withColumn("key", F.xxhash64("ids"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = rows.groupBy("ids").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(F.xxhash64("ids").alias("key"), "ids", "first", "group_size")
    # Joined on (key, ids), not on the grouping column alone, so that both sides are dealt anew
    # and the adaptive skew join may split the rows of a large group.
    return rows.join(groups, ["key", "ids"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that exact dedup keeps, all columns: one row for each group of equal texts."""
    kept = exact_dedup(docs).where("kept").select("doc_id", F.col("text_sha256").alias("tag"))
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")
    return keep_rows(docs, kept, F.sha2(normal, 256))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(read_table(spark, folder, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
