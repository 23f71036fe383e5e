"""Row-level changes to the index, as new DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_path(batch: DataFrame, order: str) -> DataFrame:
    """The row with the greatest ``order`` of each path.

    An aggregate, not a window: it combines before the shuffle, so a path repeated in a
    third of the batch still reaches its reducer as one row per task.
    """
    columns = [c for c in batch.columns if c != order]
    packed = batch.groupBy("path").agg(F.max_by(F.struct(*columns), order).alias("__row"))
    return packed.select("__row.*")


def upsert_replace(index: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` replace index rows of the same path; the rest stays.

    ``batch`` holds each path once and the columns of the index. Only paths travel for the
    anti join, so a small batch is broadcast and the index is not shuffled.
    """
    kept = index.join(batch.select("path"), "path", "left_anti")
    return kept.select(*index.columns).unionByName(batch.select(*index.columns))


def upsert_patch(index: DataFrame, batch: DataFrame, owned: Sequence[str]) -> DataFrame:
    """Overwrite only the ``owned`` columns of indexed paths; paths not in the index are ignored."""
    renamed = batch.select(
        "path", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in owned]
    )
    joined = index.join(renamed, "path", "left")
    return joined.select(
        *[
            F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in owned else F.col(c)
            for c in index.columns
        ]
    )


def update_formats(index: DataFrame, hits: DataFrame) -> DataFrame:
    """Set ``pronom_id`` of every hit; set ``mime_type`` only where the hit names a real type."""
    found = hits.where(F.coalesce(F.col("puid"), F.lit("")) != "").select(
        "path", F.col("puid").alias("__puid"), F.col("mime_type").alias("__mime")
    )
    usable = F.coalesce(F.col("__mime"), F.lit("")).isin("", "application/octet-stream")
    return (
        index.join(found, "path", "left")
        .withColumn("pronom_id", F.coalesce("__puid", "pronom_id"))
        .withColumn("mime_type", F.when(usable, F.col("mime_type")).otherwise(F.col("__mime")))
        .select(*index.columns)
    )
