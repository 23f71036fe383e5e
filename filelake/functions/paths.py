"""Path and size expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def suffix(name: Column) -> Column:
    """Last extension with its dot; none for dot files such as ``.bashrc`` or a trailing dot."""
    return F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1)


def strip_uri(path: Column) -> Column:
    """Plain path of a ``file:`` URI as Spark sources report it."""
    return F.regexp_replace(path, r"^file:/+", "/")


def under_any(path: Column, prefixes: list[str]) -> Column:
    """Whether the path is one of the prefixes or lies below one.

    Whole path components are compared, so ``/a/b`` does not take ``/a/bc``. Plain
    prefix predicates reach the Parquet scan.
    """
    hit = F.lit(False)
    for prefix in prefixes:
        clean = prefix.rstrip("/") or "/"
        below = clean if clean == "/" else clean + "/"
        hit = hit | (path == F.lit(clean)) | path.startswith(below)
    return hit


def glob_regex(pattern: str) -> str:
    """Java regex for a shell glob; ``*`` also crosses slashes, as in name matching."""
    out: list[str] = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body.replace("^", "\\^")) + "]")
            i = close
        else:
            out.append(re.escape(ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def format_bytes(size: Column) -> Column:
    """Size with two decimals and a unit up to TB; ``0 B`` when there is no number."""
    out = F.when(size.isNull(), F.lit("0 B"))
    units = ["B", "KB", "MB", "GB", "TB"]
    for power, unit in enumerate(units):
        # Halves go to the even digit; the JVM's formatter alone would round them up.
        text = F.format_string("%.2f " + unit, F.bround(size.cast("double") / F.lit(float(1024**power)), 2))
        out = out.otherwise(text) if unit == units[-1] else out.when(size < F.lit(1024 ** (power + 1)), text)
    return out
