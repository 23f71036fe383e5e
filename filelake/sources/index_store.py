"""The index as versioned Parquet folders, and the scan log.

A version is either a full snapshot or a batch of changes on top of the version before:
rows that replace others, or a patch of some columns. Writing a batch costs as much as the
batch, not as the index; readers apply the few batches since the last snapshot with joins
on the path, in which small batches are broadcast. Every ``max_batches`` changes the
result is written out as a snapshot again.

A version becomes visible when Spark's committer has written its ``_SUCCESS`` marker, so
readers never see half of one. One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from filelake.operators.upsert import upsert_patch, upsert_replace
from filelake.schemas import FILE_METADATA, SCAN_LOG

# A column of written batches that readers of the index do not see: why a stage failed for a row.
STAGE_ERROR = "stage_error"
_FULL, _REPLACE, _PATCH = "full", "replace", "patch"


def _columns(rows: DataFrame) -> list[str]:
    return [f.name for f in FILE_METADATA] + [c for c in rows.columns if c == STAGE_ERROR]


class IndexStore:
    def __init__(self, spark: SparkSession, location: str, max_batches: int = 8):
        self.spark = spark
        self.location = location.rstrip("/")
        self.max_batches = max_batches

    def versions(self) -> list[tuple[int, str, str]]:
        """Complete versions in order: number, kind and folder."""
        jvm = self.spark._jvm
        base = jvm.org.apache.hadoop.fs.Path(f"{self.location}/index")
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return []
        found = []
        for status in fs.listStatus(base):
            folder = status.getPath()
            number, _, kind = folder.getName().removeprefix("v").partition(".")
            if fs.exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
                found.append((int(number), kind, folder.toString()))
        return sorted(found)

    def current_version(self) -> int:
        """Highest complete version, 0 if there is none."""
        return max((number for number, _, _ in self.versions()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The index as of a version, by default the current one."""
        index = self.spark.createDataFrame([], FILE_METADATA)
        chain = [v for v in self.versions() if version is None or v[0] <= version]
        last_full = max((i for i, v in enumerate(chain) if v[1] == _FULL), default=0)
        for _, kind, folder in chain[last_full:]:
            if kind == _PATCH:
                batch = self.spark.read.parquet(folder)
                index = upsert_patch(index, batch, [c for c in batch.columns if c != "path"])
            else:
                batch = self.spark.read.schema(FILE_METADATA).parquet(folder)
                index = batch if kind == _FULL else upsert_replace(index, batch)
        return index

    def _write(self, rows: DataFrame, kind: str) -> int:
        version = self.current_version() + 1
        rows.write.mode("overwrite").parquet(f"{self.location}/index/v{version:08d}.{kind}")
        return version

    def write(self, index: DataFrame) -> int:
        """Write a full snapshot. Files are sorted by hash for row-group pruning."""
        return self._write(index.select(*_columns(index)).sortWithinPartitions("crypto_hash"), _FULL)

    def _add(self, batch: DataFrame, kind: str) -> int:
        version = self._write(batch, kind)
        kinds = [k for _, k, _ in self.versions()]
        since = len(kinds) - 1 - max(i for i, k in enumerate(kinds) if k == _FULL)
        if since >= self.max_batches:
            self.write(self.read())
        return version

    def replace(self, batch: DataFrame) -> int:
        """Rows of ``batch``, unique by path, replace those of the same path or are added."""
        return self._add(batch.select(*_columns(batch)), _REPLACE) if self.current_version() else self.write(batch)

    def patch(self, batch: DataFrame, owned: list[str]) -> int:
        """Overwrite the ``owned`` columns of indexed paths."""
        if not self.current_version():
            return 0
        return self._add(batch.select("path", *owned), _PATCH)

    def batch(self, version: int) -> DataFrame:
        """Rows written with a version, with the reasons of failed stages if they were kept."""
        folder = next(folder for number, _, folder in self.versions() if number == version)
        return self.spark.read.schema(T.StructType([*FILE_METADATA.fields, T.StructField(STAGE_ERROR, T.StringType())])).parquet(folder)

    def count_of(self, version: int) -> int:
        """Rows written with a version, from the file footers."""
        folder = next(folder for number, _, folder in self.versions() if number == version)
        return self.spark.read.parquet(folder).count()

    def log(self, **row) -> None:
        """Append one transition of a scan to the log."""
        frame = self.spark.createDataFrame([tuple(row.get(f.name) for f in SCAN_LOG)], SCAN_LOG)
        frame.coalesce(1).write.mode("append").parquet(f"{self.location}/scan_log")

    def scan_log(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCAN_LOG).parquet(f"{self.location}/scan_log")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCAN_LOG)
            raise
