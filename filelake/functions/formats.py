"""Type and format identification from the first and last bytes of a file.

A signature is a byte pattern at an offset window counted from the beginning (BOF) or the
end (EOF) of the file.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD_BYTES = 4096
TAIL_BYTES = 64
DEFAULT_MIME = "application/octet-stream"
EMPTY_MIME = "inode/x-empty"


class Signature(NamedTuple):
    """A byte pattern and where it must stand.

    ``pattern`` is a regular expression over upper-case hexadecimal byte pairs; a pattern
    without any operator is compared as plain bytes. With the anchor ``TEXT`` it is
    lower-case text instead, sought after a byte order mark and leading white space.
    """

    mime_type: str
    puid: str
    anchor: str
    min_off: int
    max_off: int
    pattern: str


def _text(value: str) -> str:
    return value.encode("latin-1").hex().upper()


_ODF = "application/vnd.oasis.opendocument."
_OOXML = "application/vnd.openxmlformats-officedocument."
_ZIP_ENTRY = "504B0304"
MAIL_HEADERS = ["Return-Path: ", "Received: ", "Delivered-To: ", "MIME-Version: ", "Message-ID: ", "From: ", "Date: "]

# Public format identifiers with their byte patterns, most specific first.
SIGNATURES = [
    Signature("application/pdf", "fmt/14", "BOF", 0, 0, _text("%PDF-1.0")),
    Signature("application/pdf", "fmt/15", "BOF", 0, 0, _text("%PDF-1.1")),
    Signature("application/pdf", "fmt/16", "BOF", 0, 0, _text("%PDF-1.2")),
    Signature("application/pdf", "fmt/17", "BOF", 0, 0, _text("%PDF-1.3")),
    Signature("application/pdf", "fmt/18", "BOF", 0, 0, _text("%PDF-1.4")),
    Signature("application/pdf", "fmt/19", "BOF", 0, 0, _text("%PDF-1.5")),
    Signature("application/pdf", "fmt/20", "BOF", 0, 0, _text("%PDF-1.6")),
    Signature("application/pdf", "fmt/276", "BOF", 0, 0, _text("%PDF-1.7")),
    Signature("application/pdf", "fmt/1129", "BOF", 0, 0, _text("%PDF-2.0")),
    Signature("image/png", "fmt/11", "BOF", 0, 0, "89504E470D0A1A0A"),
    Signature("image/gif", "fmt/3", "BOF", 0, 0, _text("GIF87a")),
    Signature("image/gif", "fmt/4", "BOF", 0, 0, _text("GIF89a")),
    Signature("image/jpeg", "fmt/43", "BOF", 0, 0, "FFD8FFE0....4A46494600"),
    Signature("image/jpeg", "fmt/645", "BOF", 0, 0, "FFD8FFE1....457869660000"),
    Signature("image/jpeg", "fmt/41", "BOF", 0, 0, "FFD8FF"),
    Signature("image/tiff", "fmt/353", "BOF", 0, 0, "49492A00"),
    Signature("image/tiff", "fmt/353", "BOF", 0, 0, "4D4D002A"),
    Signature("image/webp", "fmt/566", "BOF", 0, 0, "52494646.{8}57454250"),
    Signature("audio/x-wav", "fmt/6", "BOF", 0, 0, "52494646.{8}57415645"),
    Signature("video/x-msvideo", "fmt/5", "BOF", 0, 0, "52494646.{8}415649"),
    Signature("video/quicktime", "x-fmt/384", "BOF", 4, 4, "667479707174"),
    Signature("video/mp4", "fmt/199", "BOF", 4, 4, "66747970"),
    Signature("video/x-matroska", "fmt/569", "BOF", 0, 0, "1A45DFA3"),
    Signature("audio/flac", "fmt/279", "BOF", 0, 0, _text("fLaC")),
    Signature("application/ogg", "fmt/944", "BOF", 0, 0, _text("OggS")),
    *[Signature("audio/mpeg", "fmt/134", "BOF", 0, 0, start) for start in ["494433", "FFFB", "FFF3", "FFF2"]],
    Signature(_ODF + "text", "fmt/291", "BOF", 0, 0, _ZIP_ENTRY + ".{52}" + _text("mimetype" + _ODF + "text")),
    Signature(
        _ODF + "spreadsheet", "fmt/295", "BOF", 0, 0, _ZIP_ENTRY + ".{52}" + _text("mimetype" + _ODF + "spreadsheet")
    ),
    Signature(
        _ODF + "presentation", "fmt/293", "BOF", 0, 0, _ZIP_ENTRY + ".{52}" + _text("mimetype" + _ODF + "presentation")
    ),
    Signature(
        "application/epub+zip", "fmt/483", "BOF", 0, 0, _ZIP_ENTRY + ".{52}" + _text("mimetypeapplication/epub+zip")
    ),
    Signature(
        _OOXML + "wordprocessingml.document", "fmt/412", "BOF", 0, 0, _ZIP_ENTRY + "(?:..)*?" + _text("word/")
    ),
    Signature(_OOXML + "spreadsheetml.sheet", "fmt/214", "BOF", 0, 0, _ZIP_ENTRY + "(?:..)*?" + _text("xl/workbook")),
    Signature(
        _OOXML + "presentationml.presentation", "fmt/215", "BOF", 0, 0, _ZIP_ENTRY + "(?:..)*?" + _text("ppt/")
    ),
    Signature("application/zip", "x-fmt/263", "BOF", 0, 0, "504B0304"),
    Signature("application/zip", "x-fmt/263", "BOF", 0, 0, "504B0506"),
    Signature("application/gzip", "x-fmt/266", "BOF", 0, 0, "1F8B08"),
    Signature("application/x-bzip2", "x-fmt/268", "BOF", 0, 0, "425A683[1-9]314159265359"),
    Signature("application/x-xz", "fmt/1098", "BOF", 0, 0, "FD377A585A00"),
    Signature("application/x-7z-compressed", "fmt/484", "BOF", 0, 0, "377ABCAF271C"),
    Signature("application/x-rar", "x-fmt/264", "BOF", 0, 0, "526172211A07"),
    Signature("application/x-tar", "x-fmt/265", "BOF", 257, 257, _text("ustar")),
    Signature("application/x-ole-storage", "fmt/111", "BOF", 0, 0, "D0CF11E0A1B11AE1"),
    Signature("application/vnd.sqlite3", "fmt/729", "BOF", 0, 0, _text("SQLite format 3") + "00"),
    Signature("application/x-executable", "fmt/689", "BOF", 0, 0, "7F454C46"),
    Signature("application/x-dosexec", "x-fmt/411", "BOF", 0, 0, "4D5A(?:..)+?50450000"),
    Signature("application/java-vm", "x-fmt/415", "BOF", 0, 0, "CAFEBABE"),
    Signature("image/bmp", "fmt/119", "BOF", 0, 0, "424D.{8}00000000..00000028000000"),
    Signature("application/postscript", "fmt/124", "BOF", 0, 0, _text("%!PS-Adobe")),
    Signature("text/rtf", "fmt/355", "BOF", 0, 0, _text("{\\rtf1")),
    Signature("text/html", "fmt/471", "TEXT", 0, 0, "<!doctype html>"),
    Signature("text/html", "fmt/96", "TEXT", 0, 0, "<!doctype html"),
    Signature("text/html", "fmt/96", "TEXT", 0, 0, "<html"),
    Signature("image/svg+xml", "fmt/92", "TEXT", 0, 0, "<svg"),
    Signature("text/xml", "fmt/101", "TEXT", 0, 0, "<?xml "),
    *[Signature("message/rfc822", "fmt/278", "BOF", 0, 0, _text(header)) for header in MAIL_HEADERS],
]

# Types told by extension where the bytes say nothing.
EXTENSION_MIME = {
    ".csv": "text/csv",
    ".json": "application/json",
    ".iso": "application/x-iso9660-image",
    ".doc": "application/msword",
    ".xls": "application/vnd.ms-excel",
    ".ppt": "application/vnd.ms-powerpoint",
}


_LITERAL = re.compile(r"(?:[0-9A-F]{2})*")
# Bytes by which signatures are looked up; those that pass are compared whole.
KEY_BYTES = 4
_ENTRY = "p int, mime_type string, puid string, literal string, pattern string"


class _Place(NamedTuple):
    """Where the key of some signatures stands: anchor, offset and length; length 0 for signatures without one."""

    anchor: str
    offset: int
    length: int


def _entry(priority: int, signature: Signature) -> tuple[_Place, str, dict]:
    """Place, key and table entry of a signature. Keys and literals are upper-case hexadecimal."""
    low, high, pattern = signature.min_off, signature.max_off, signature.pattern
    fixed = _text(pattern) if signature.anchor == "TEXT" else _LITERAL.match(pattern).group()
    # An operator after a byte pair applies to it, so that pair is not fixed.
    if signature.anchor != "TEXT" and len(fixed) < len(pattern) and pattern[len(fixed)] in "?*+{":
        fixed = fixed[:-2]
    whole = signature.anchor == "TEXT" or len(fixed) == len(pattern)
    gap = f"(?:..){{{low},{high}}}" if high else ""
    regex = f"{pattern}{gap}$" if signature.anchor == "EOF" else f"^{gap}{pattern}"
    entry = {"p": priority, "mime_type": signature.mime_type, "puid": signature.puid, "literal": fixed, "pattern": None if whole else regex}
    if low != high or not fixed or (signature.anchor == "EOF" and (not whole or low)):
        return _Place(signature.anchor, 0, 0), "", {**entry, "literal": "", "pattern": regex}
    size = min(KEY_BYTES, len(fixed) // 2)
    key = fixed[-2 * size :] if signature.anchor == "EOF" else fixed[: 2 * size]
    return _Place(signature.anchor, low, size), key, entry


def _found(place: _Place, table: dict[str, list[dict]], head: Column, tail: Column) -> Column:
    """Entries of one place whose signature matches. The table is one literal, however many entries it has."""
    if place.length == 0:
        entries = F.from_json(F.lit(json.dumps(table[""])), f"array<struct<{_ENTRY}>>")
        source = tail if place.anchor == "EOF" else head
        return F.filter(entries, lambda e: F.rlike(F.hex(source), e["pattern"]))
    lookup = F.from_json(F.lit(json.dumps(table)), f"map<string,array<struct<{_ENTRY}>>>")
    if place.anchor == "TEXT":
        start = F.ltrim(head.cast("string"), F.lit("\ufeff \t\r\n"))

        def text(size: Column) -> Column:
            return F.hex(F.lower(F.substring(start, F.lit(1), size)))

        candidates = F.coalesce(F.element_at(lookup, text(F.lit(place.length))), F.array().cast(f"array<struct<{_ENTRY}>>"))
        return F.filter(candidates, lambda e: text((F.length(e["literal"]) / 2).cast("int")) == e["literal"])

    def cut(size: Column) -> Column:
        if place.anchor == "EOF":
            return F.hex(F.substring(tail, F.greatest(F.lit(1), F.octet_length(tail) - size + 1), size))
        return F.hex(F.substring(head, F.lit(place.offset + 1), size))

    candidates = F.coalesce(F.element_at(lookup, cut(F.lit(place.length))), F.array().cast(f"array<struct<{_ENTRY}>>"))
    whole = lambda e: cut((F.length(e["literal"]) / 2).cast("int")) == e["literal"]
    return F.filter(candidates, lambda e: whole(e) & (e["pattern"].isNull() | F.rlike(F.hex(head), e["pattern"])))


def best_signature(head: Column, tail: Column, signatures: list[Signature] | None = None) -> Column:
    """``struct(mime_type, puid)`` of the first matching signature, or NULL.

    Signatures are a table keyed by place and first bytes. A file looks its own bytes up, once
    per place, and only what it finds is compared whole; the least priority wins. The plan has
    one expression per place, not per signature, and files are not joined or shuffled.
    """
    places: dict[_Place, dict[str, list[dict]]] = {}
    for priority, signature in enumerate(SIGNATURES if signatures is None else signatures):
        place, key, entry = _entry(priority, signature)
        places.setdefault(place, {}).setdefault(key, []).append(entry)
    if not places:
        return F.lit(None).cast("struct<mime_type: string, puid: string>")
    best = F.array_min(F.concat(*[_found(p, places[p], head, tail) for p in sorted(places)]))
    return F.when(best.isNotNull(), F.struct(best["mime_type"].alias("mime_type"), best["puid"].alias("puid")))


def looks_like_text(head: Column) -> Column:
    """Valid UTF-8 without NUL bytes; a character cut at the end of the head is allowed for."""
    size = F.octet_length(head)
    cut = F.when(size < HEAD_BYTES, F.is_valid_utf8(head.cast("string")))
    for drop in range(4):
        cut = cut.when(F.is_valid_utf8(F.substring(head, F.lit(1), size - drop).cast("string")), F.lit(True))
    return cut.otherwise(F.lit(False)) & (F.locate("\x00", F.decode(head, "ISO-8859-1")) == 0)


def mime_type(signature: Column, head: Column, ext: Column) -> Column:
    by_extension = F.coalesce(*[F.when(F.lower(ext) == e, F.lit(m)) for e, m in EXTENSION_MIME.items()])
    return (
        F.when(F.octet_length(head) == 0, F.lit(EMPTY_MIME))
        .when(signature.isNotNull() & (signature["mime_type"] != "application/x-ole-storage"), signature["mime_type"])
        .otherwise(
            F.coalesce(
                by_extension, signature["mime_type"], F.when(looks_like_text(head), "text/plain"), F.lit(DEFAULT_MIME)
            )
        )
    )


def with_format(files: DataFrame, signatures: list[Signature] | None = None) -> DataFrame:
    """Add ``mime_type`` and ``puid`` to rows with ``head``, ``tail`` and ``ext``."""
    return (
        files.withColumn("__sig", best_signature(F.col("head"), F.col("tail"), signatures))
        .withColumn("mime_type", mime_type(F.col("__sig"), F.col("head"), F.col("ext")))
        .withColumn("puid", F.col("__sig.puid"))
        .drop("__sig")
    )


def identify_formats(files: DataFrame, signatures: list[Signature] | None = None) -> DataFrame:
    """``(path, puid, mime_type)`` of the files with a known format."""
    hit = best_signature(F.col("head"), F.col("tail"), signatures)
    # Exploding the one hit or none evaluates it once, where a filter would repeat it.
    hits = files.select("path", F.explode(F.array_compact(F.array(hit))).alias("hit"))
    return hits.select("path", "hit.puid", "hit.mime_type")
