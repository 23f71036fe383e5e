"""Selections over the index: what to scan again and what to refine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelake.functions.paths import under_any

# Types whose text a refine run extracts.
TEXT_MIME_TYPES = [
    "text/plain",
    "text/html",
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.oasis.opendocument.text",
    "application/vnd.oasis.opendocument.spreadsheet",
    "application/vnd.oasis.opendocument.presentation",
    "message/rfc822",
]


def changed_files(listing: DataFrame, index: DataFrame) -> DataFrame:
    """Listed files that are new to the index or strictly newer than their index row.

    The index holds each path once, so the join key cannot be hot.
    """
    known = index.select("path", F.col("mtime").alias("__known"))
    return (
        listing.join(known, "path", "left")
        .where(F.col("__known").isNull() | (F.col("mtime") > F.col("__known")))
        .drop("__known")
    )


def _tried(index: DataFrame) -> Column:
    return F.coalesce(F.col("text_extracted"), F.lit(False)) if "text_extracted" in index.columns else F.lit(False)


def needs_text() -> Column:
    return F.col("mime_type").isin(TEXT_MIME_TYPES) & F.col("content").isNull()


def needs_phash(mime_types: Sequence[str] | None = None) -> Column:
    kind = F.col("mime_type").isin(list(mime_types)) if mime_types else F.col("mime_type").startswith("image/")
    return kind & F.col("perceptual_hash").isNull()


def text_to_refine(index: DataFrame) -> DataFrame:
    return index.where(needs_text() & ~_tried(index))


def text_to_refine_under(index: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    return index.where(under_any(F.col("path"), list(prefixes)) & F.col("content").isNull() & ~_tried(index))


def images_to_refine_under(
    index: DataFrame, prefixes: Sequence[str], mime_types: Sequence[str] | None = None
) -> DataFrame:
    return index.where(under_any(F.col("path"), list(prefixes)) & needs_phash(mime_types))


def formats_to_refine_under(index: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    return index.where(under_any(F.col("path"), list(prefixes)))


def existing_only(index: DataFrame, listing: DataFrame) -> DataFrame:
    """Index rows whose file is still listed."""
    return index.join(listing.select("path"), "path", "left_semi")


def pending_counts(index: DataFrame) -> DataFrame:
    """How many rows each refine run would take, and the size of the index, in one pass."""
    return index.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(needs_text() & ~_tried(index)).alias("text_pending"),
        F.count_if(needs_phash()).alias("image_pending"),
        F.count_if(F.col("pronom_id").isNull()).alias("format_pending"),
    )
