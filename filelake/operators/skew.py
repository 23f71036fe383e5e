"""Joins of rows with per-group values that stay balanced when one group is huge.

A plain window or join over a group key sends the whole group to one task. Here every
row also carries a *slice* number derived from its own identity, so a group is spread
over up to ``SLICES`` tasks. Only the (group, slice) combinations that exist are ever
built, so small groups, which are nearly all of them, cost one combination each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 512
SMALL_SPLIT_BYTES = 32 << 20
_SLICE = "__slice"


def _slice(spread: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*spread), F.lit(SLICES)).cast("int")


def with_group_stats(
    rows: DataFrame,
    key: str | Sequence[str],
    spread: str | Sequence[str],
    having: Column | None = None,
    *,
    count: str | None = None,
    minimum: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Attach a group's row count and minima to each of its rows.

    ``having`` filters groups by the attached columns. Rows are aggregated per
    (key, slice) before the shuffle, the at most ``SLICES`` partial results of a key are
    combined, and the rows meet the result again on (key, slice). Rows with a NULL key have
    no group and are left out.
    """
    key = [key] if isinstance(key, str) else list(key)
    spread = [spread] if isinstance(spread, str) else list(spread)
    minimum = dict(minimum or {})

    partial_aggs = [F.count(F.lit(1)).alias(count)] if count else []
    partial_aggs += [F.min(expr).alias(name) for name, expr in minimum.items()]
    partial = rows.groupBy(*key, _slice(spread).alias(_SLICE)).agg(*partial_aggs)

    group = Window.partitionBy(*key)
    combined = {name: F.min(name).over(group) for name in minimum}
    if count:
        combined[count] = F.sum(count).over(group)
    stats = partial.withColumns(combined)
    if having is not None:
        stats = stats.where(having)
    return rows.withColumn(_SLICE, _slice(spread)).join(stats, [*key, _SLICE]).drop(_SLICE)


def lookup(rows: DataFrame, table: DataFrame, key: str, spread: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join of ``rows`` with ``table``, which is unique on ``key``, inner or left; ``rows`` may be skewed on it."""
    spread = [spread] if isinstance(spread, str) else list(spread)
    sliced = rows.withColumn(_SLICE, _slice(spread))
    used = sliced.select(key, _SLICE).distinct().join(table, key)
    return sliced.join(used, [key, _SLICE], how).drop(_SLICE)


def spread(rows: DataFrame, by: str) -> DataFrame:
    """Deal rows out to all cores before heavy per-row work, if the input is small.

    A small Parquet file is one row group and so one task. Inputs whose estimated size
    gives every core a fair part of a split are left alone, so large tables are never
    shuffled for this. Only the planner's estimate is asked; nothing runs.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores, by) if size < cores * SMALL_SPLIT_BYTES else rows


def pair_tasks(rows: DataFrame, key: Sequence[str], ident: str, size: str, task_rows: int) -> DataFrame:
    """Split each group into blocks of about ``task_rows`` rows and list the block pairs of every row.

    Adds ``block`` (own block), ``lo`` and ``hi`` (the block pair, ``lo <= hi``). Two rows
    of a group meet in exactly one block pair, and no block pair holds more than about
    twice ``task_rows`` rows, however large the group.
    """
    blocks = F.ceil(F.col(size) / F.lit(task_rows)).cast("int")
    return (
        rows.withColumn("__blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64(ident), F.col("__blocks")).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        .withColumn("lo", F.least("block", "__other"))
        .withColumn("hi", F.greatest("block", "__other"))
        .drop("__blocks", "__other")
    )
