"""Bytes of documents and images as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import trim_control

# Media type by file name ending; anything else is a JPEG.
MEDIA_TYPES = {".png": "image/png", ".gif": "image/gif", ".webp": "image/webp"}
DEFAULT_MEDIA_TYPE = "image/jpeg"


def document_type(content: Column) -> Column:
    """``pdf``, ``docx`` (any ZIP) or ``txt`` by the first bytes."""
    return (
        F.when(F.substring(content, 1, 4) == F.lit(bytes([0x25, 0x50, 0x44, 0x46])), "pdf")
        .when(F.substring(content, 1, 2) == F.lit(bytes([0x50, 0x4B])), "docx")
        .otherwise("txt")
    )


def document_text(content: Column) -> Column:
    """Trimmed text of UTF-8 bytes; broken sequences become replacement characters."""
    return trim_control(F.make_valid_utf8(content.cast("string")))


def media_type(path: Column) -> Column:
    """Media type by the lower-cased end of the file name."""
    name = F.lower(path)
    found = None
    for ending, kind in MEDIA_TYPES.items():
        test = name.endswith(ending)
        found = F.when(test, kind) if found is None else found.when(test, kind)
    return found.otherwise(DEFAULT_MEDIA_TYPE)


def data_url(media: Column, content: Column) -> Column:
    """``data:`` URL of the bytes, base64 on one line."""
    return F.concat(F.lit("data:"), media, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))
