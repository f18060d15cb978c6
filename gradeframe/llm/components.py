"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeframe.llm.common import checkpointed


def join_dealt(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """An equi join on one column or several whose sides are both dealt anew, so that the adaptive skew join may split a hot key.

    A side that comes out of an aggregation on the key would otherwise keep its partitions, and
    then neither side can be split.
    """
    keys = [key] if isinstance(key, str) else key
    salt = f"hash of {' '.join(keys)}"
    return left.withColumn(salt, F.xxhash64(*keys)).join(
        right.withColumn(salt, F.xxhash64(*keys)), [*keys, salt], how).drop(salt)


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (u > v): neighbours of a node are hung on the smallest of them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("u", "m"))
    hung = join_dealt(both, least, "u")
    if large:
        moved = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of ``edges`` (u, v; any order, any type that orders).

    Alternates large and small stars until the edges no longer change; the number of rounds grows with
    the logarithm of the longest path. Each round is written to the checkpoint folder.
    """
    now = checkpointed(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    digest = lambda table: table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = digest(now)
    while before[0]:
        now = checkpointed(star(star(now, large=True), large=False))
        after = digest(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
