"""Folder trees as a data source: ``spark.read.format("file_tree")`` and ``readStream``.

Options: ``roots`` and ``exclude`` (JSON lists), ``caseSensitive``, ``units`` (how many
sub-trees the plan deals out, at least) and, for streams, ``overlapSeconds``. Rows are those
of a listing, and rows with ``error`` for roots that are no folders, folders that cannot be
read and names that are not UTF-8.

Planning opens folders level by level until there are enough of them; each is a unit of work
that a task walks to its leaves. Exclusion rules prune whole sub-trees, and so do filters of
a query on ``path`` and ``parent``: a folder is not opened if nothing below it can pass.
Other filters on the columns are applied before rows leave the Python worker.

A stream's offset is a time: a batch holds the files whose change time (ctime, so that files
moved in with an old mtime and such with one to come are seen) lies after the last offset and
not after the new one. File systems stamp coarsely, so a batch looks ``overlapSeconds`` back;
a file may come twice, and whoever writes compares paths and times, as the index does.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import PurePosixPath
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from filelake.schemas import LISTING
from filelake.sources.listing import excluder, resolve_roots, system_rules

FORMAT = "file_tree"
SCHEMA = "path string, filename string, ext string, parent string, size_bytes long, mtime double, error string"
_COLUMNS = [*LISTING.names, "error"]
_ARROW = pa.schema(
    [("path", pa.string()), ("filename", pa.string()), ("ext", pa.string()), ("parent", pa.string()), ("size_bytes", pa.int64())]
    + [("mtime", pa.float64()), ("error", pa.string())]
)
_ROWS = 10_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Unit(NamedTuple):
    """A folder to read, and whether the folders below it are read as well."""

    folder: str
    deep: bool


class Work(ds.InputPartition):
    def __init__(self, units: list[Unit], errors: list[tuple[str, str]], window: tuple[int, int] | None = None):
        self.units, self.errors, self.window = units, errors, window


class Condition(NamedTuple):
    """What a pushed filter says about rows, and about folders: may something below pass?"""

    keeps: Callable[[dict], bool]
    enters: Callable[[str], bool]


def _anywhere(folder: str) -> bool:
    return True


_ORDERED: dict[type, Callable[[Any, Any], bool]] = {
    ds.EqualTo: lambda a, b: a == b,
    ds.GreaterThan: lambda a, b: a > b,
    ds.GreaterThanOrEqual: lambda a, b: a >= b,
    ds.LessThan: lambda a, b: a < b,
    ds.LessThanOrEqual: lambda a, b: a <= b,
    ds.StringStartsWith: lambda a, b: a.startswith(b),
    ds.StringEndsWith: lambda a, b: a.endswith(b),
    ds.StringContains: lambda a, b: b in a,
    ds.In: lambda a, b: a in b,
}


def _leads_to(column: str, value: str) -> Callable[[str], bool]:
    """Folders above or at an entry whose ``column`` is ``value``."""
    if column == "path":
        return lambda folder: value.startswith(folder.rstrip("/") + "/")
    return lambda folder: value == folder or value.startswith(folder.rstrip("/") + "/")


def condition(filter_: ds.Filter) -> Condition | None:
    """How a filter is applied here; None if it is left to Spark."""
    negated = isinstance(filter_, ds.Not)
    inner = filter_.child if isinstance(filter_, ds.Not) else filter_
    column = inner.attribute[0] if len(getattr(inner, "attribute", ())) == 1 else None
    if column not in _COLUMNS:
        return None
    if isinstance(inner, (ds.IsNull, ds.IsNotNull)):
        wanted = isinstance(inner, ds.IsNull) != negated
        return Condition(lambda row: (row[column] is None) == wanted, _anywhere)
    compare = _ORDERED.get(type(inner))
    if compare is None:
        return None
    value = inner.value
    if value is None or (isinstance(inner, ds.In) and None in value):
        return None
    keeps = lambda row: row[column] is not None and compare(row[column], value) != negated
    enters = _anywhere
    if column in ("path", "parent"):
        # What a row's column begins with if the row lies below a folder.
        stem = (lambda folder: folder.rstrip("/") + "/") if column == "path" else (lambda folder: folder)
        if isinstance(inner, ds.StringStartsWith):
            if negated:
                enters = lambda folder: not stem(folder).startswith(value)
            else:
                enters = lambda folder: stem(folder).startswith(value) or value.startswith(stem(folder))
        elif isinstance(inner, ds.StringContains) and negated:
            enters = lambda folder: value not in stem(folder)
        elif isinstance(inner, ds.EqualTo) and not negated:
            enters = _leads_to(column, value)
        elif isinstance(inner, ds.In) and not negated:
            targets = [_leads_to(column, v) for v in value]
            enters = lambda folder: any(t(folder) for t in targets)
    return Condition(keeps, enters)


class Walker:
    """Reads units under the rules and pushed conditions."""

    def __init__(self, options: dict[str, str]):
        self.roots = json.loads(options.get("roots") or "[]")
        self.exclude = json.loads(options.get("exclude") or "[]")
        self.case_sensitive = (options.get("caseSensitive") or "true").lower() == "true"
        self.units = int(options.get("units") or 256)
        self.conditions: list[Condition] = []

    def _enters(self, folder: str) -> bool:
        return all(c.enters(folder) for c in self.conditions)

    def plan(self, window: tuple[int, int] | None = None) -> list[Work]:
        """Units dealt out evenly; planning itself opens about as many folders as there are units."""
        good, bad = resolve_roots(self.roots)
        excluded = excluder(self.exclude, self.case_sensitive)
        errors = [(b, "not a folder") for b in bad]
        shallow: list[Unit] = []
        open_ = [r for r in good if self._enters(r)]
        while open_ and len(open_) < self.units and len(shallow) < 4 * self.units:
            below: list[str] = []
            for folder in open_:
                found = _folders(folder, excluded)
                # A folder that cannot be read is a unit: its task reports it.
                below += [f for f in found or [] if self._enters(f)]
                shallow.append(Unit(folder, False))
            open_ = below
        units = shallow + [Unit(f, True) for f in open_]
        count = max(1, min(self.units, len(units)))
        return [Work(units[k::count], errors if k == 0 else [], window) for k in range(count)]

    def read(self, work: Work) -> Iterator[pa.RecordBatch]:
        excluded = excluder(self.exclude, self.case_sensitive)
        rows: list[dict] = []

        def add(row: dict) -> None:
            if all(c.keeps(row) for c in self.conditions):
                rows.append(row)

        for path, message in work.errors:
            add(_fault(path, message))
        todo = list(reversed(work.units))
        while todo:
            folder, deep = todo.pop()
            try:
                with os.scandir(folder) as entries:
                    for entry in entries:
                        if excluded(entry.name, entry.path):
                            continue
                        try:
                            entry.path.encode()
                            if entry.is_dir(follow_symlinks=False):
                                if deep and self._enters(entry.path):
                                    todo.append(Unit(entry.path, True))
                            elif entry.is_file(follow_symlinks=False):
                                stat = entry.stat(follow_symlinks=False)
                                if work.window and not work.window[0] < stat.st_ctime_ns <= work.window[1]:
                                    continue
                                values = (entry.path, entry.name, PurePosixPath(entry.name).suffix, folder, stat.st_size, stat.st_mtime, None)
                                add(dict(zip(_COLUMNS, values)))
                        except FileNotFoundError:
                            continue
                        except UnicodeEncodeError:
                            add(_fault(entry.path.encode("utf-8", "replace").decode(), "the name is not UTF-8"))
                        if len(rows) >= _ROWS:
                            yield _batch(rows)
                            rows.clear()
            except FileNotFoundError:
                continue
            except OSError as e:
                add(_fault(folder, f"{type(e).__name__}: {e}"))
        if rows:
            yield _batch(rows)


def _folders(folder: str, excluded: Callable[[str, str], bool]) -> list[str] | None:
    try:
        with os.scandir(folder) as entries:
            return [e.path for e in entries if e.is_dir(follow_symlinks=False) and not excluded(e.name, e.path) and _is_text(e.path)]
    except OSError:
        return None


def _is_text(path: str) -> bool:
    try:
        path.encode()
    except UnicodeEncodeError:
        return False
    return True


def _fault(path: str, message: str) -> dict:
    return {**dict.fromkeys(_COLUMNS), "path": path, "error": message}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _ARROW)


class TreeReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.walker = Walker(options)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for filter_ in filters:
            found = condition(filter_)
            if found is None:
                yield filter_
            else:
                self.walker.conditions.append(found)

    def partitions(self) -> Sequence[ds.InputPartition]:
        return self.walker.plan()

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        return self.walker.read(partition)


class TreeStream(ds.DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.walker = Walker(options)
        self.overlap = int(float(options.get("overlapSeconds") or 2) * 1e9)

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> Sequence[ds.InputPartition]:
        return self.walker.plan((start["until"] - self.overlap, end["until"]))

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        return self.walker.read(partition)


class TreeSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(self.options)


def _options(spark: SparkSession, roots: Iterable[str], exclude: Iterable[str], system_defaults: bool, case_sensitive: bool) -> dict[str, str]:
    spark.dataSource.register(TreeSource)
    spark.conf.set(PUSHDOWN, "true")
    roots = list(roots)
    rules = set(exclude) | (set(system_rules(spark, resolve_roots(roots)[0])) if system_defaults else set())
    return {
        "roots": json.dumps(roots), "exclude": json.dumps(sorted(rules)), "caseSensitive": str(case_sensitive).lower(),
        "units": str(spark.sparkContext.defaultParallelism * 8),
    }


def read_tree(
    spark: SparkSession, roots: Iterable[str], exclude: Iterable[str] = (), system_defaults: bool = True, case_sensitive: bool = True
) -> DataFrame:
    """Files below the roots, and rows with ``error``; a lazy counterpart of ``listing.walk``.

    Nested roots reach a file twice, so rows are made distinct by path when there are several.
    """
    roots = list(roots)
    found = spark.read.format(FORMAT).options(**_options(spark, roots, exclude, system_defaults, case_sensitive)).load()
    return found.dropDuplicates(["path"]) if len(set(roots)) > 1 else found


def stream_tree(
    spark: SparkSession, roots: Iterable[str], exclude: Iterable[str] = (), system_defaults: bool = True, case_sensitive: bool = True
) -> DataFrame:
    """The same rows as a stream of new and changed files."""
    return spark.readStream.format(FORMAT).options(**_options(spark, roots, exclude, system_defaults, case_sensitive)).load()
