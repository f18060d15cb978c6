"""Request sink, reply source, result sink, and tables that lie by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .schemas import REPLIES


def write_requests(requests: DataFrame, path: str, key: str = "pair_id") -> None:
    """One JSON line per request: its key, its model if it has one, and the ``body`` to send.

    The key comes back with the reply: lines of many tasks have no order that could tie them together.
    """
    named = [F.col(key).cast("string").alias(key), *[c for c in ("model",) if c in requests.columns], "body"]
    requests.select(*named).write.mode("errorifexists").json(path)


def read_replies(
    spark: SparkSession, path: str, kind: str = "parquet", stream: bool = False, received_at: str | None = None
) -> DataFrame:
    """Replies of the outside service, as a table or as a stream; the schema is never guessed.

    ``received_at`` names a column with the time of delivery, if the service writes one.
    """
    schema = T.StructType([*REPLIES.fields, *([T.StructField(received_at, T.TimestampType())] if received_at else [])])
    reader = (spark.readStream if stream else spark.read).schema(schema)
    return reader.format(kind).load(path)


def once_delivered(replies: DataFrame, received_at: str, delay: str = "1 hour", key: str = "pair_id") -> DataFrame:
    """Each reply once, also if it is delivered again up to ``delay`` later in a stream.

    A reply is named by key, model and attempt. The state holds the names, and drops them behind the watermark.
    """
    names = [key, "model", "attempt_no"]
    if not replies.isStreaming:
        return replies.dropDuplicates(names)
    return replies.withWatermark(received_at, delay).dropDuplicatesWithinWatermark(names)


def write_results(results: DataFrame, path: str) -> None:
    """Results as parquet, one folder per status."""
    results.write.mode("errorifexists").partitionBy("status").parquet(path)


def write_by_key(table: DataFrame, name: str, buckets: int, key: str = "pair_id", path: str | None = None) -> DataFrame:
    """The table in ``buckets`` files by the hash of ``key``, under ``name`` in the catalogue.

    Tables of one key and one number of buckets are joined on it without a shuffle, however often that is done;
    requests and their replies are such a pair. Rows are dealt by key before they are written, so a bucket is one
    file; its size is that of the table by ``buckets``, as long as no single key holds more. Without ``path`` the
    table goes to the warehouse. A name that is taken is an error.
    """
    writer = table.repartition(buckets, key).write.bucketBy(buckets, key).mode("errorifexists")
    if path:
        writer = writer.option("path", path)
    writer.format("parquet").saveAsTable(name)
    return table.sparkSession.table(name)
