"""Run row-local operators, or one batch job per micro-batch, over a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_folder

Step = Callable[[DataFrame], DataFrame]


def _state(stream: DataFrame, name: str, checkpoint: str | None) -> str:
    return checkpoint or shared_folder(stream.sparkSession, f"streams/{name}")


def run_row_local(
    stream: DataFrame,
    step: Step,
    path: str,
    name: str,
    checkpoint: str | None = None,
    partition_by: tuple[str, ...] = (),
) -> StreamingQuery:
    """Write ``step(stream)`` as parquet until the input seen so far is used up.

    The file sink and the checkpoint together give each row exactly once, also
    after a lost executor or a restart.
    """
    writer = (
        step(stream).writeStream.format("parquet").outputMode("append").queryName(name)
        .option("path", path)
        .option("checkpointLocation", _state(stream, name, checkpoint))
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start()


def run_per_batch(
    stream: DataFrame, step: Step, path: str, name: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Run a batch job with joins or aggregates on each micro-batch.

    Each batch replaces its own ``batch_id`` folder, so a repeated batch leaves
    the same result. Aggregates see one micro-batch;
    where keys span several, use `run_recomputed`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).queryName(name)
        .option("checkpointLocation", _state(stream, name, checkpoint))
        .trigger(availableNow=True)
        .start()
    )


def run_keyed(stream: DataFrame, path: str, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Write the changed rows of a streaming aggregate, micro-batch by micro-batch.

    Spark's state holds what a key needs, so a batch reads only its own rows, however long the stream is. Each
    batch replaces its own ``batch_id`` folder, so a repeated batch leaves the same result; `latest` reads
    the last row of each key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode("update").foreachBatch(write).queryName(name)
        .option("checkpointLocation", _state(stream, name, checkpoint))
        .trigger(availableNow=True)
        .start()
    )


def run_recomputed(
    stream: DataFrame, step: Step, log: str, path: str, name: str, key: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Run any batch job per key although a key's rows arrive in several micro-batches.

    For jobs that are one aggregate, `run_keyed` does without the log, which this reads whole.

    Each micro-batch is added to the stored log, and the keys it touches are computed anew from all
    their rows up to then. Both folders are replaced by ``batch_id``, so a repeated batch leaves the same
    result; `latest` reads the result of each key's last batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")
        stored = spark.read.parquet(log).where(F.col("batch_id") <= batch_id)
        touched = stored.where(F.col("batch_id") == batch_id).select(key).distinct()
        whole = stored.drop("batch_id").join(touched, key, "left_semi")
        step(whole).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).queryName(name)
        .option("checkpointLocation", _state(stream, name, checkpoint))
        .trigger(availableNow=True)
        .start()
    )


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Results of `run_recomputed`: of each key those of its last batch."""
    results = spark.read.parquet(path)
    last = results.groupBy(key).agg(F.max("batch_id").alias("batch_id"))
    return results.join(last, [key, "batch_id"], "left_semi").drop("batch_id")
