"""Reading tables, the shared folder, and small helpers on columns and Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.session import open_file_system as open_file_system
from filelake.session import shared_folder, ship_package

# Rows handed to Python at a time: texts can be long, so batches are short.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the workers and keep Arrow batches short."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return ship_package(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, bytes are compressed."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal_longs(values: Sequence[int | None]) -> Column:
    """A constant array of numbers, kept as one literal."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<bigint>")


def batches_of(iterator: Iterable[pa.RecordBatch], limit: int) -> Iterable[list[pa.RecordBatch]]:
    """Runs of batches of about ``limit`` bytes."""
    held, size = [], 0
    for batch in iterator:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held
