"""Recursive listing of shared file systems, level by level.

Every level of the tree is one distributed job over the folders found by the level
above, dealt out evenly, so one huge sub-tree is walked by many tasks. Folders that a
rule excludes are not entered. Hidden files are listed and symbolic links are not
followed. The roots must be mounted under the same path on every executor.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from fnmatch import fnmatchcase
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.operators.rules import MACOS_MARKERS, WINDOWS_MARKERS, default_rules, is_glob
from filelake.schemas import LISTING
from filelake.session import cut_lineage

_LEVEL = "is_dir boolean, error string, path string, filename string, ext string, parent string, size_bytes long, mtime double"
_NAMES = ["is_dir", "error", *LISTING.names]


def resolve_roots(roots: Iterable[str]) -> tuple[list[str], list[str]]:
    """Absolute, distinct, sorted folders, and the given roots that are no folders."""
    good, bad = set(), []
    for root in roots:
        full = os.path.realpath(os.path.expanduser(root))
        if os.path.isdir(full):
            good.add(full)
        else:
            bad.append(root)
    return sorted(good), bad


def excluder(rules: Iterable[str], case_sensitive: bool) -> Callable[[str, str], bool]:
    fold = (lambda s: s) if case_sensitive else str.lower
    rules = {fold(r) for r in rules}
    globs = [r for r in rules if is_glob(r)]
    exact = rules.difference(globs)

    def excluded(name: str, path: str) -> bool:
        name, path = fold(name), fold(path)
        return name in exact or path in exact or any(fnmatchcase(name, g) or fnmatchcase(path, g) for g in globs)

    return excluded


def _read_folders(rules: list[str], case_sensitive: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        excluded = excluder(rules, case_sensitive)
        rows: list[tuple] = []
        for batch in batches:
            for folder in batch["path"]:
                try:
                    with os.scandir(folder) as entries:
                        for entry in entries:
                            if excluded(entry.name, entry.path):
                                continue
                            try:
                                if entry.is_dir(follow_symlinks=False):
                                    rows.append((True, None, entry.path, entry.name, "", folder, 0, 0.0))
                                elif entry.is_file(follow_symlinks=False):
                                    stat = entry.stat(follow_symlinks=False)
                                    ext = PurePosixPath(entry.name).suffix
                                    rows.append(
                                        (False, None, entry.path, entry.name, ext, folder, stat.st_size, stat.st_mtime)
                                    )
                            except FileNotFoundError:
                                continue
                            if len(rows) >= 10_000:
                                yield pd.DataFrame(rows, columns=_NAMES)
                                rows = []
                except FileNotFoundError:
                    continue
                except OSError as e:
                    rows.append((None, f"{type(e).__name__}: {e}", folder, "", "", "", 0, 0.0))
        if rows:
            yield pd.DataFrame(rows, columns=_NAMES)

    return run


def list_files(
    spark: SparkSession,
    roots: Iterable[str],
    exclude: Iterable[str] = (),
    system_defaults: bool = True,
    case_sensitive: bool = True,
    parallelism: int | None = None,
) -> DataFrame:
    """Every regular file below the roots: path, name, extension, folder, size and mtime."""
    return walk(spark, roots, exclude, system_defaults, case_sensitive, parallelism)[0]


def walk(
    spark: SparkSession,
    roots: Iterable[str],
    exclude: Iterable[str] = (),
    system_defaults: bool = True,
    case_sensitive: bool = True,
    parallelism: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The files below the roots, and ``(path, error)`` of roots that are no folders and of folders that cannot be read.

    Nested roots may reach a file twice, so rows are made distinct by path when there are
    several roots.
    """
    good, bad = resolve_roots(roots)
    rules = sorted(set(exclude) | (set(system_rules(spark, good)) if system_defaults else set()))
    parallelism = parallelism or spark.sparkContext.defaultParallelism * 4
    read = _read_folders(rules, case_sensitive)

    files: DataFrame = spark.createDataFrame([], LISTING)
    errors = spark.createDataFrame([(b, "not a folder") for b in bad], "path string, error string")
    folders = spark.createDataFrame([(r,) for r in good], "path string")
    while True:
        level = cut_lineage(folders.repartition(parallelism).mapInPandas(read, _LEVEL))
        files = files.unionByName(level.where(~F.col("is_dir")).select(*LISTING.names))
        errors = errors.unionByName(level.where("error is not null").select("path", "error"))
        folders = level.where("is_dir").select("path")
        if folders.isEmpty():
            break
    return (files.dropDuplicates(["path"]), errors.distinct()) if len(good) > 1 else (files, errors)


def system_rules(spark: SparkSession, roots: list[str]) -> list[str]:
    """Default rules of the given roots; only the marker names are looked up."""
    markers = WINDOWS_MARKERS + MACOS_MARKERS
    found = [(r, m) for r in roots for m in markers if os.path.exists(os.path.join(r, m))]
    if not found:
        return []
    return [row["rule"] for row in default_rules(spark.createDataFrame(found, "root string, name string")).collect()]
