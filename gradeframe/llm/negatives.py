"""Hard-negative mining: slots between the upper limits of an anchor's positives.

An anchor's positives are its nearest rows of the same label. The score of a positive is the upper limit of its
window of negatives and a share of it the lower one, so the windows of one anchor overlap. Their upper
limits split the scores into disjoint slots: a slot holds what is not above its limit and above the next one. One
pass over all tiles keeps the best ``k`` of each slot, in every task and in the merges of their lists. The best k of
a window without its lower limit are then the first k of its own slot and all slots below, which hold
descending scores one after another; the lower limit only cuts the end of that list. So a negative is kept once,
however many windows hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeframe.llm.common import checkpointed, read_table, slices
from gradeframe.llm.tiles import BLOCKS, BLOCKS_ARROW, LEAST, OTHER, SAME, best_of_all, finite, packed, without_itself

ANCHOR_STEP, SCALE = 100, 256
POSITIVES, NEGATIVES = 5, 5
LOWER, UPPER = 80, 100  # percent of the positive's score


def labelled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and the components floor(scale * x) of every row that takes part."""
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
                       F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
        .select("vec_id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    )


def with_limits(blocks: DataFrame, near: DataFrame, width: int) -> DataFrame:
    """The blocks with the ``limits`` of their rows, from task, number, i and limits; others let nothing in."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            (row,) = batch.to_pylist()
            limits = np.full((len(row["ids"]) // 8, width), LEAST)
            for own in row.pop("rows"):
                limits[own["i"]] = own["limits"]
            row |= {"limits": limits.tobytes(), "width": width}
            yield pa.RecordBatch.from_pylist([row], BLOCKS_ARROW)

    # A block holds a bounded number of rows.
    rows = near.groupBy("task", "number").agg(F.collect_list(F.struct("i", "limits")).alias("rows"))
    return blocks.join(rows, ["task", "number"]).select(*BLOCKS_ARROW.names, "rows").mapInArrow(put, BLOCKS)


def share(score: Column, percent: int, upwards: bool) -> Column:
    """The whole score next to that percentage, below or above, without leaving whole numbers."""
    times = score * F.lit(percent) + F.lit(99 if upwards else 0)
    return F.call_function("div", times - F.pmod(times, F.lit(100)), F.lit(100)).cast("bigint")


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   lower: int = LOWER, upper: int = UPPER) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id and both scores.

    Both sides are rows (vec_id, label, v); anchors are rows of ``vectors``. Scores are inner products; higher ones
    come first, ties by smaller vec_id. Positives are the first other rows of the anchor's label; negatives the
    first rows of other labels whose score is from ``lower`` to ``upper`` percent of the positive's, both
    included. An anchor without a positive, and a positive without a negative, gives no row. Rows that repeat
    a vec_id are rows of their own, as anchors and as candidates. A vector meets only vectors of its length.
    Other columns are ignored; an empty table gives an empty result.
    """
    shards, asked, which = packed(vectors), packed(anchors), ["task", "number", "i"]
    score = lambda entry: F.bitwise_not(entry.lost)
    near = checkpointed(
        best_of_all(asked, shards, positives + 1, SAME)
        .select("query_id", *which, without_itself(positives).alias("positives")).where(F.size("positives") > 0))
    # Upper limits of the slots, falling; places without a positive let nothing in. Last the least useful score.
    above = F.transform("positives", lambda p: share(score(p), upper, False))
    limits = F.concat(above, F.array_repeat(F.lit(LEAST), positives - F.size("positives")),
                      F.array(share(score(F.element_at("positives", -1)), lower, True)))
    bounded = with_limits(asked, near.select(*which, limits.alias("limits")), positives + 1)
    slots = best_of_all(bounded, shards, negatives, OTHER).groupBy(*which).agg(
        F.array_sort(F.collect_list(F.struct("slot", "top"))).alias("slots"))
    windows = near.join(slots, which).select(
        F.col("query_id").alias("anchor_id"), "slots", F.posexplode("positives").alias("window", "positive"))
    # The window's own slot and all below it hold falling scores.
    below = F.flatten(F.transform(F.filter("slots", lambda s: s.slot >= F.col("window")), lambda s: s.top))
    first = F.filter(F.slice(below, 1, negatives), lambda n: score(n) * 100 >= score(F.col("positive")) * lower)
    return windows.select(
        "anchor_id", F.col("positive.vec_id").alias("positive_id"), score(F.col("positive")).alias("positive_score"),
        F.posexplode(first).alias("pos", "negative"),
    ).select("anchor_id", "positive_id", (F.col("pos") + 1).alias("rank"), F.col("negative.vec_id").alias("negative_id"),
             "positive_score", score(F.col("negative")).alias("negative_score"))


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by ANCHOR_STEP; rows divisible by 7 bear the next label first."""
    table = read_table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = labelled(table.withColumn("label", moved))
    return hard_negatives(vectors, vectors.where(F.col("vec_id") % ANCHOR_STEP == 0))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
    AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
