"""Files of documents and images as rows of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.files import document_text, document_type, media_type


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path, modificationTime, length, content``; the bytes are read only if selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def read_images(spark: SparkSession, path: str, pattern: str = "*.{png,PNG,gif,webp,jpg,jpeg}") -> DataFrame:
    """``path, content, media_type`` of image files."""
    return read_files(spark, path, pattern).select("path", "content", media_type(F.col("path")).alias("media_type"))


def with_document_text(documents: DataFrame) -> DataFrame:
    """Adds ``doc_type``, ``text`` and ``document_error`` from ``content``.

    Text files are decoded. PDF and Word files are named and sent to the rejects:
    reading them is left to a tool ahead of this one.
    """
    typed = documents.withColumn("doc_type", document_type(F.col("content"))).withColumn(
        "_text", F.when(F.col("doc_type") == "txt", document_text(F.col("content")))
    )
    return (
        typed.withColumn(
            "document_error",
            F.when(F.col("doc_type") != "txt", F.concat(F.lit("No text reader for type "), F.col("doc_type")))
            .when(F.coalesce(F.col("_text") == "", F.lit(True)), "Document is empty."),
        )
        .withColumn("text", F.when(F.col("document_error").isNull(), F.col("_text")))
        .drop("_text")
    )


def split_documents(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with text and rejects; together they are the input."""
    return read.where("document_error is null"), read.where("document_error is not null")
