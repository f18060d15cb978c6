"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"
TOKENIZER = "word_bpe_49k.json"

# White space and words as every operator of this package reads them: ASCII only.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application that all executors share.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``. Only a local session without that
    setting, where all tasks are on one machine, gets a folder of its own; elsewhere that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get(CHECKPOINT_KEY, None)
        if not named and not context.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} is not set; name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(table: DataFrame) -> DataFrame:
    """The table, written once to the shared checkpoint folder and read from there."""
    shared_folder(table.sparkSession)
    return table.checkpoint()


def stored(table: DataFrame) -> DataFrame:
    """The table, written once as Parquet below the shared folder and read from there; smaller than a checkpoint."""
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def keep_rows(docs: DataFrame, kept: DataFrame, tag: Column) -> DataFrame:
    """The rows of ``docs`` whose doc_id and ``tag`` (a hash of the text) are in ``kept`` (doc_id, tag), one of each.

    All columns stay as they are. Rows that repeat doc_id and text become one; which of them stays is
    settled by their other plain columns.
    """
    key = lambda: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    named = docs.select(F.struct("*").alias("doc"), key().alias("key"), tag.alias("tag"))
    chosen = named.join(kept.select(key().alias("key"), "tag").distinct(), ["key", "tag"], "left_semi")
    others = [F.col("doc")[f.name] for f in docs.schema if f.name not in ("doc_id", "text")
              and isinstance(f.dataType, T.AtomicType)]
    once = Window.partitionBy("key", "tag").orderBy(*others or [F.lit(0)])
    return chosen.withColumn("nth", F.row_number().over(once)).where("nth = 1").select("doc.*")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
