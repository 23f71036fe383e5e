"""Archive members as rows, read by byte range.

The members of all archives come from a *directory*: one row per entry with the byte range
that holds it. A zip file's directory lies at its end and a plain tar's headers are skipped
through, so no entry is read for it. Entries are dealt out to tasks in pieces of bounded
bytes, however large an archive is. A compressed tar has no ranges; it is one piece.

Archives in archives are followed level by level: they are written to the shared folder under
their digest, and the next round takes them like files. There is no limit of depth; a member
whose digest is that of an archive around it would go on for ever and is reported instead.

Bytes are hashed and typed where they are read, and not carried along: rows keep the place of
their entry, and later steps that want the bytes read them from there.
"""

from __future__ import annotations

import hashlib
import tarfile
import uuid
import zipfile
from calendar import timegm
from collections.abc import Callable, Iterable, Iterator
from pathlib import PurePosixPath
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelake.functions.formats import HEAD_BYTES, TAIL_BYTES, with_format
from filelake.session import cut_lineage, ensure_checkpoint_dir
from filelake.sources.files import CHUNK, FAULTS, MEMBER, STORED, STREAM, ZIP_METHODS, MemberReader, TailFile, entry_names, file_system, open_file

# Fixed values.
ARCHIVE_TYPES = ["application/zip", "application/x-tar", "application/gzip", "application/x-bzip2", "application/x-xz"]
UNEXPANDED_EXTENSIONS = [".epub", ".cbz", ".cbr"]

# What a task reads at a time, in packed bytes and entries.
PIECE_BYTES = 32 << 20
PIECE_ENTRIES = 500
_TAIL = 1 << 20
_ZIP_MAGIC = (b"PK\x03\x04", b"PK\x05\x06")

DIRECTORY = f"container string, around array<string>, place array<long>, name string, mtime double, member {MEMBER}, error string"
MEMBERS = (
    "path string, filename string, ext string, parent string, size_bytes long, mtime double, crypto_hash string, head binary, tail binary, "
    f"error string, around array<string>, place array<long>, member {MEMBER}"
)


def is_expandable(mime: Column, ext: Column, excluded: list[str] | None = None) -> Column:
    return mime.isin(ARCHIVE_TYPES) & ~F.lower(ext).isin(UNEXPANDED_EXTENSIONS if excluded is None else excluded)


def safe_name(name: str) -> str | None:
    parts = PurePosixPath(name.lstrip("/")).parts
    return None if not parts or ".." in parts else "/".join(parts)


def _zip_entries(file: Any) -> Iterator[tuple[str, float, dict, str | None]]:
    with zipfile.ZipFile(file) as archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            method, fault = ZIP_METHODS.get(info.compress_type), None
            if method is None:
                fault = f"compression type {info.compress_type}"
            elif info.flag_bits & 1:
                fault = "the entry is encrypted"
            place = {"method": method, "offset": info.header_offset, "packed": info.compress_size, "size": info.file_size, "crc": info.CRC}
            yield info.filename, float(timegm((*info.date_time, 0, 0, 0))), place, fault


def _tar_entries(file: Any) -> Iterator[tuple[str, float, dict, str | None]]:
    """Entries of a tar file; those of a compressed one, and of one with sparse entries, are read as a stream."""
    start = file.read(6)
    file.seek(0)
    packed = start.startswith((b"\x1f\x8b\x08", b"BZh", b"\xfd7zXZ\x00"))
    with tarfile.open(fileobj=file, mode="r:*" if packed else "r:") as archive:
        for info in archive:
            if info.isfile():
                ranged = not packed and not info.issparse()
                place = {"method": STORED if ranged else STREAM, "offset": info.offset_data, "packed": info.size, "size": info.size, "crc": None}
                yield info.name, float(info.mtime), place, None


def _digest(path: str) -> str:
    digest = hashlib.sha256()
    with open_file(path) as file:
        while data := file.read(CHUNK):
            digest.update(data)
    return digest.hexdigest()


def _entries(row: dict) -> Iterator[dict]:
    """Directory rows of one archive; a fault ends it, what came before stays."""
    base = {"container": row["path"], "around": row["around"], "place": row["place"]}
    piece = size = count = 0
    try:
        if not base["around"]:
            base["around"] = [_digest(row["file"])]
        with open_file(row["file"]) as file:
            start = file.read(4)
            file.seek(0)
            for number, (name, mtime, place, fault) in enumerate((_zip_entries if start in _ZIP_MAGIC else _tar_entries)(file)):
                if size >= PIECE_BYTES or count >= PIECE_ENTRIES:
                    piece, size, count = piece + 1, 0, 0
                size, count = size + place["packed"], count + 1
                # One task reads a stream from its start.
                member = {**place, "file": row["file"], "entry": number, "piece": -1 if place["method"] == STREAM else piece}
                yield {**base, "place": [*row["place"], number], "name": name, "mtime": mtime, "member": member, "error": fault}
    except FAULTS as e:
        yield {**base, "name": None, "mtime": None, "member": None, "error": f"{type(e).__name__}: {e}"}


def _by_batches(rows: Iterable[dict], schema: pa.Schema, count: int = 5_000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= count:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_MEMBER_TYPE = pa.struct(
    [("file", pa.string()), ("method", pa.string())] + [(n, pa.int64()) for n in ("offset", "packed", "size", "crc", "entry", "piece")]
)
_DIRECTORY = pa.schema(
    [("container", pa.string()), ("around", pa.list_(pa.string())), ("place", pa.list_(pa.int64())), ("name", pa.string())]
    + [("mtime", pa.float64()), ("member", _MEMBER_TYPE), ("error", pa.string())]
)
_MEMBERS = pa.schema(
    [(n, pa.string()) for n in ("path", "filename", "ext", "parent")]
    + [("size_bytes", pa.int64()), ("mtime", pa.float64()), ("crypto_hash", pa.string()), ("head", pa.binary()), ("tail", pa.binary())]
    + [("error", pa.string()), ("around", pa.list_(pa.string())), ("place", pa.list_(pa.int64())), ("member", _MEMBER_TYPE)]
)


def member_directory(containers: DataFrame, parallelism: int) -> DataFrame:
    """One row per entry of ``containers (path, file, around, place)``, and rows with ``error``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_batches((entry for b in batches for row in b.to_pylist() for entry in _entries(row)), _DIRECTORY)

    return containers.select("path", "file", "around", "place").repartition(parallelism, "path").mapInArrow(run, DIRECTORY)


def deal_out(rows: DataFrame, parallelism: int) -> DataFrame:
    """Members with their pieces together and in order, pieces dealt to tasks; rows without a member go anywhere."""
    spread = F.coalesce(F.col("member.piece"), F.xxhash64("path" if "path" in rows.columns else "container"))
    return rows.repartition(parallelism, F.col("member.file"), spread).sortWithinPartitions("member.file", "member.entry")


def _probe_member(reader: MemberReader, member: dict) -> tuple[int, str, bytes, bytes]:
    """Size, digest, head and tail; the head of a zip file ends with the names of its entries."""
    digest, size, head, tail = hashlib.sha256(), 0, b"", b""
    for data in reader.chunks(member):
        digest.update(data)
        size += len(data)
        if len(head) < HEAD_BYTES:
            head += data[: HEAD_BYTES - len(head)]
        tail = (tail + data)[-_TAIL:]
    if head.startswith(_ZIP_MAGIC[0]):
        try:
            names = entry_names(TailFile(size, tail))
        except TailFile.Before as before:
            # A directory longer than what was held: read once more, and keep it whole.
            names = entry_names(TailFile(size, _from(reader, member, before.offset)))
        head += names
    return size, digest.hexdigest(), head, tail[-TAIL_BYTES:]


def _from(reader: MemberReader, member: dict, offset: int) -> bytes:
    kept, at = [], 0
    for data in reader.chunks(member):
        if at + len(data) > offset:
            kept.append(data[max(0, offset - at) :])
        at += len(data)
    return b"".join(kept)


def _described(reader: MemberReader, row: dict) -> dict:
    base = {**dict.fromkeys(_MEMBERS.names), "around": row["around"], "place": row["place"], "path": row["container"], "error": row["error"]}
    if row["name"] is None:
        return base
    clean = safe_name(row["name"])
    if clean is None:
        return {**base, "path": f"{row['container']}/{row['name']}", "error": "unsafe member name"}
    pure = PurePosixPath(f"{row['container']}/{clean}")
    base["path"] = str(pure)
    if row["error"]:
        return base
    try:
        size, digest, head, tail = _probe_member(reader, row["member"])
    except FAULTS as e:
        return {**base, "error": f"{type(e).__name__}: {e}"}
    values = {"filename": pure.name, "ext": PurePosixPath(pure.name).suffix, "parent": str(pure.parent), "mtime": row["mtime"]}
    return {**base, **values, "size_bytes": size, "crypto_hash": digest, "head": head, "tail": tail, "member": row["member"]}


def read_directory(directory: DataFrame, parallelism: int) -> DataFrame:
    """Directory rows as members: size, digest, first and last bytes, and where the entry lies."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with MemberReader() as reader:
            yield from _by_batches((_described(reader, row) for b in batches for row in b.to_pylist()), _MEMBERS, 1_000)

    return deal_out(directory, parallelism).mapInArrow(run, MEMBERS)


def materialise(members: DataFrame, folder: str, parallelism: int, name: Callable[[dict], str]) -> DataFrame:
    """Members and files copied below ``folder``: ``path, file``; unreadable ones are left out.

    Equal names hold equal bytes, so attempts may repeat.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = file_system(folder)
        system.create_dir(inner, recursive=True)
        with MemberReader() as reader:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    part = f"{inner}/_{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
                    with system.open_output_stream(part) as out:
                        try:
                            for data in reader.pieces(row["path"], row["member"]):
                                out.write(data)
                        except FAULTS:
                            continue
                    system.move(part, f"{inner}/{name(row)}")
                    rows.append((row["path"], f"{folder}/{name(row)}"))
                arrays = [pa.array([r[i] for r in rows], pa.string()) for i in range(2)]
                yield pa.RecordBatch.from_arrays(arrays, ["path", "file"])

    return deal_out(members.select("path", "crypto_hash", "ext", "member"), parallelism).mapInArrow(run, "path string, file string")


def scratch_folder(df: DataFrame, name: str) -> str:
    """A new folder that all executors see."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def expand_archives(containers: DataFrame, excluded: list[str] | None = None, parallelism: int | None = None) -> DataFrame:
    """Typed rows of all members of ``containers (path[, crypto_hash])``, with the path ``container/member``.

    Rows with ``error`` tell what could not be read; other members of the archive are kept.
    Zip members carry the entry's own time, read as UTC. ``place`` has the entry numbers from
    the outermost archive inwards, ``member`` where the bytes are.
    """
    parallelism = parallelism or containers.sparkSession.sparkContext.defaultParallelism * 4
    digest = F.array("crypto_hash") if "crypto_hash" in containers.columns else F.array().cast("array<string>")
    level = containers.select("path", F.col("path").alias("file"), digest.alias("around"), F.array().cast("array<long>").alias("place"))
    folder, found = scratch_folder(containers, "archives"), []
    while True:
        rows = with_format(read_directory(member_directory(level, parallelism), parallelism)).drop("head", "tail")
        rows = cut_lineage(rows)
        nested = F.col("error").isNull() & is_expandable(F.col("mime_type"), F.col("ext"), excluded)
        again = F.array_contains("around", F.col("crypto_hash"))
        found.append(rows)
        loops = rows.where(nested & again)
        inner = rows.where(nested & ~again)
        if not rows.where(nested).isEmpty():
            nulls = {c: F.lit(None) for c in ("filename", "ext", "parent", "size_bytes", "mtime", "crypto_hash", "member", "mime_type", "puid")}
            typed = {c: v.cast(rows.schema[c].dataType) for c, v in nulls.items()}
            found.append(loops.withColumns({**typed, "error": F.lit("the archive contains itself")}))
        if inner.isEmpty():
            break
        written = cut_lineage(materialise(inner.dropDuplicates(["crypto_hash"]), folder, parallelism, lambda row: row["crypto_hash"]))
        files = written.join(inner.select("path", "crypto_hash"), "path").select("crypto_hash", "file").distinct()
        level = inner.join(files, "crypto_hash").select("path", "file", F.array_append("around", F.col("crypto_hash")).alias("around"), "place")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def last_entries(members: DataFrame) -> DataFrame:
    """The last of the entries a container has under one path, as unpacking would leave it; errors stay."""
    good = members.where("error is null")
    last = good.groupBy("path").agg(F.max("place").alias("place"))
    return good.join(last, ["path", "place"], "left_semi").unionByName(members.where("error is not null")).drop("place", "around")
