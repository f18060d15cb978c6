"""Exact top-k search: tiled matrix products, a selection per tile, and merged top lists.

Every query block meets every block of vectors once (``tiles``); such a tile is one matrix product, of which each
query keeps its best ``k``. The lists of a query are merged in a tree with a fan-in of ``tiles.FAN_IN``, so
no task ever holds more than that many lists of k entries for a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.llm.common import read_table
from gradeframe.llm.tiles import best_of_all, finite, packed, without_itself

K, QUERY_STEP, SCALE = 20, 20, 64


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, a label and the components floor(scale * x) of every vector that takes part."""
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                       F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        .where(F.col("vec_id").isNotNull() & finite(F.col("v")))
        .select("vec_id", F.lit(0).alias("label"), F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Each query's k rows of ``vectors`` with the highest inner product: query_id, rank, vec_id, score.

    Both sides are quantized vectors (vec_id, label, v); queries are rows of ``vectors``. Ties go to the
    smaller vec_id. A query's own row is no candidate; other rows of its vec_id are. A vector meets only
    vectors of its length. Rows that repeat a vec_id are queries and candidates of their own. Queries
    without a candidate give no row. Scores beyond 64 bits wrap as long arithmetic does.
    """
    tops = best_of_all(packed(queries), packed(vectors), k + 1)
    return tops.select("query_id", F.posexplode(without_itself(k)).alias("pos", "t")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), "t.vec_id", F.bitwise_not("t.lost").alias("score"))


def op1_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by QUERY_STEP, candidates all rows.

    Null vectors, and vectors with a null or non-finite component, take no part, nor do rows without
    vec_id. An empty table gives an empty result; other columns are ignored.
    """
    vectors = quantized(read_table(spark, folder, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
