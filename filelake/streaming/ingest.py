"""Continuous ingest of new files into the index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filelake.functions.paths import glob_regex
from filelake.operators.incremental import changed_files
from filelake.operators.rules import drop_junk
from filelake.plans.pipeline import ScanOptions, build_rows, stage_errors
from filelake.schemas import LISTING
from filelake.session import cut_lineage
from filelake.sources.index_store import IndexStore
from filelake.sources.tree import stream_tree


def ingest(
    store: IndexStore,
    folders: str | Sequence[str],
    checkpoint: str,
    options: ScanOptions | None = None,
    glob: str = "*",
    on_errors: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Start a query that indexes every new or changed file below the folders and stops when it is done.

    The stream brings paths; files are read, typed, hashed and expanded by the same plan as a
    scan, so a row is what a scan would have written. Each micro-batch is one upsert by path
    of files that are newer than their row, so a batch that is repeated after a failure, or
    a file that comes twice, leaves the index as it was. ``on_errors`` gets a batch's errors.
    """
    options = options or ScanOptions()

    def upsert(batch: DataFrame, batch_id: int) -> None:
        found = cut_lineage(batch)
        named = found.where("error is null").where(F.col("filename").rlike(glob_regex(glob))).select(*LISTING.names)
        # Junk never gets a row, so it would be new for ever.
        fresh = cut_lineage(changed_files(drop_junk(named).dropDuplicates(["path"]), store.read()))
        rows, errors = build_rows(fresh, options)
        unlisted = found.where("error is not null")
        errors = errors.unionByName(
            unlisted.select(F.current_timestamp().alias("ts"), F.lit("listing").alias("stage"), "path", F.col("error").alias("message"))
        )
        if not fresh.isEmpty():
            errors = errors.unionByName(stage_errors(store, store.replace(rows)))
        if on_errors:
            on_errors(errors)

    roots = [folders] if isinstance(folders, str) else list(folders)
    stream = stream_tree(store.spark, roots, options.rules)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
