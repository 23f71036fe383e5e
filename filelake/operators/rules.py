"""Exclusion rules over listings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelake.functions.paths import file_name, glob_regex, suffix

# Names, extensions and folders left out by default.
JUNK_FILENAMES = [".ds_store", "thumbs.db"]
JUNK_EXTENSIONS = [".swp", ".swo", ".tmp", ".part", ".crdownload", ".log"]
DEFAULT_EXCLUDE_DIRS = [
    ".git", ".cache", "node_modules", "bower_components", "vendor",
    ".venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "build", "dist", "*.egg-info",
    ".idea", ".vscode", ".next", ".nuxt",
    "target",
]

# Entries that mark a system drive, and what is left out below it.
WINDOWS_MARKERS = ["Windows", "pagefile.sys", "Program Files"]
WINDOWS_EXCLUDES = [
    "windows", "programdata", "program files", "program files (x86)", "pagefile.sys",
    "hiberfil.sys", "swapfile.sys", "$recycle.bin", "system volume information", "msocache",
]
MACOS_MARKERS = ["System", "Library", "Applications"]
MACOS_EXCLUDES = [
    ".DocumentRevisions-V100", ".fseventsd", ".Spotlight-V100", ".Trashes", "private",
    "dev", "System", "Library", "Applications", "Users/*/Library",
]


def is_glob(rule: str) -> bool:
    return "*" in rule or "?" in rule


def excluded(path: Column, rules: Iterable[str], root: Column | None = None, case_sensitive: bool = True) -> Column:
    """Whether the path, or any folder above it and below ``root``, matches a rule.

    A rule names an entry or an absolute path; with ``*`` or ``?`` it is a glob on either.
    Rules are run parameters, so they are folded into the expression, not joined.
    """
    fold = (lambda c: c) if case_sensitive else F.lower
    rules = sorted({r if case_sensitive else r.lower() for r in rules})
    exact = [r for r in rules if not is_glob(r)]
    globs = [glob_regex(r) for r in rules if is_glob(r)]
    if not rules:
        return F.lit(False)

    path = fold(path)
    base = F.lit("") if root is None else fold(F.regexp_replace(root, "/+$", ""))
    parts = F.split(F.substring(path, F.length(base) + F.lit(2), F.length(path)), "/")
    depth = F.size(parts)

    def entry_matches(i: Column) -> Column:
        name = F.element_at(parts, i)
        full = F.concat(base, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))
        hit = name.isin(exact) | full.isin(exact) if exact else F.lit(False)
        if globs:
            pattern = "|".join(f"(?:{g})" for g in globs)
            hit = hit | name.rlike(pattern) | full.rlike(pattern)
        return hit

    return F.exists(F.sequence(F.lit(1), depth), entry_matches)


def exclude_paths(
    listing: DataFrame, rules: Iterable[str], root: str | None = None, case_sensitive: bool = True
) -> DataFrame:
    root_col = F.col(root) if root else None
    return listing.where(~excluded(F.col("path"), rules, root_col, case_sensitive))


def default_rules(entries: DataFrame) -> DataFrame:
    """Extra rules for roots that look like system drives: ``(root, platform, rule)``.

    ``entries`` holds ``(root, name)``, the top-level names below each root. Windows
    markers win over macOS markers.
    """
    seen = entries.groupBy("root").agg(
        F.max(F.col("name").isin(WINDOWS_MARKERS)).alias("windows"),
        F.max(F.col("name").isin(MACOS_MARKERS)).alias("macos"),
    )
    platform = F.when(F.col("windows"), "windows").when(F.col("macos"), "macos")
    names = F.when(F.col("platform") == "windows", F.array(*map(F.lit, WINDOWS_EXCLUDES))).otherwise(
        F.array(*map(F.lit, MACOS_EXCLUDES))
    )
    return (
        seen.withColumn("platform", platform)
        .where("platform is not null")
        .select("root", "platform", F.explode(names).alias("name"))
        .select("root", "platform", F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/"), "name").alias("rule"))
    )


def is_junk(path: Column) -> Column:
    name = F.lower(file_name(path))
    return name.isin(JUNK_FILENAMES) | suffix(name).isin(JUNK_EXTENSIONS)


def drop_junk(listing: DataFrame) -> DataFrame:
    return listing.where(~is_junk(F.col("path")))
