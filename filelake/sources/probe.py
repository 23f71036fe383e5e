"""One pass over the bytes of listed files: hash, first and last bytes."""

from __future__ import annotations

import codecs
import hashlib
import os
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelake.functions.formats import HEAD_BYTES, TAIL_BYTES
from filelake.sources.archives import deal_out
from filelake.sources.files import FAULTS, MemberReader, entry_names, open_file

_CHUNK = 1 << 20
_HELD_BYTES = 64 << 20
PROBED = "path string, filename string, ext string, parent string, size_bytes long, mtime double, crypto_hash string, head binary, tail binary, error string"
_COLUMNS = [part.split()[0] for part in PROBED.split(", ")]


def _probe(path: str) -> tuple[str, bytes, bytes]:
    digest, head, tail = hashlib.sha256(), b"", b""
    with open_file(path) as f:
        while chunk := f.read(_CHUNK):
            digest.update(chunk)
            if len(head) < HEAD_BYTES:
                head += chunk[: HEAD_BYTES - len(head)]
            tail = (tail + chunk)[-TAIL_BYTES:]
        if head.startswith(b"PK\x03\x04"):
            head += entry_names(f)
    return digest.hexdigest(), head, tail


def probe_files(listing: DataFrame, parallelism: int | None = None) -> DataFrame:
    """Add ``crypto_hash``, ``head``, ``tail`` and ``error`` to a listing.

    Files are streamed by the executors, whatever their size, and dealt out evenly by path
    so that neighbouring large files do not end up in one task. Files that vanished are
    dropped, other I/O errors are kept in ``error``.
    """
    parallelism = parallelism or listing.sparkSession.sparkContext.defaultParallelism * 4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                base = (row.path, row.filename, row.ext, row.parent, row.size_bytes, row.mtime)
                try:
                    rows.append((*base, *_probe(row.path), None))
                except FileNotFoundError:
                    continue
                except OSError as e:
                    rows.append((*base, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    wanted = ["path", "filename", "ext", "parent", "size_bytes", "mtime"]
    return listing.select(*wanted).repartition(parallelism, "path").mapInPandas(run, PROBED)


def present_files(files: DataFrame) -> DataFrame:
    """Rows whose file still exists."""

    @F.pandas_udf("boolean")
    def exists(paths: pd.Series) -> pd.Series:
        return paths.map(os.path.isfile)

    return files.where(exists("path"))


def _placed(files: DataFrame) -> DataFrame:
    """Members of one archive piece together and in order; plain files stay where they are."""
    if "member" not in files.columns:
        return files
    return deal_out(files, files.sparkSession.sparkContext.defaultParallelism * 4)


def _members(batch: pa.RecordBatch) -> list[dict | None]:
    return batch.column("member").to_pylist() if "member" in batch.schema.names else [None] * batch.num_rows


def with_bytes(files: DataFrame, wanted: Column) -> DataFrame:
    """Add ``content``, the bytes of the wanted files, and ``read_error``; both NULL for others.

    A row with a ``member`` is read from its archive. Rows are handed on whenever a moderate
    number of bytes is held, however many rows a batch of paths has.
    """
    columns = files.columns
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("read_error", T.StringType())])

    def read(reader: MemberReader, path: str, member: dict | None) -> tuple[bytes | None, str | None]:
        try:
            return b"".join(reader.pieces(path, member)), None
        except FAULTS as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with MemberReader() as reader:
            for batch in batches:
                paths, flags, members = batch.column("path").to_pylist(), batch.column("__wanted").to_pylist(), _members(batch)
                start, held, blobs = 0, 0, []
                for i, (path, flag, member) in enumerate(zip(paths, flags, members)):
                    blobs.append(read(reader, path, member) if flag else (None, None))
                    held += len(blobs[-1][0] or b"")
                    if held >= _HELD_BYTES or i == batch.num_rows - 1:
                        part = batch.slice(start, len(blobs))
                        arrays = [part.column(c) for c in columns]
                        arrays += [pa.array([b[0] for b in blobs], pa.binary()), pa.array([b[1] for b in blobs], pa.string())]
                        yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "content", "read_error"])
                        start, held, blobs = i + 1, 0, []

    return _placed(files.withColumn("__wanted", F.coalesce(wanted, F.lit(False)))).mapInArrow(run, schema)


def text_chunks(files: DataFrame, chars: int = 500_000, overlap: int = 1_000) -> DataFrame:
    """``(path, chunk)`` rows of whole text files and archive members, however large; invalid UTF-8 is dropped.

    Neighbouring chunks share ``overlap`` characters, so that nothing short is cut in two.
    """

    def texts(reader: MemberReader, path: str, member: dict | None) -> Iterator[str]:
        decoder, held, size = codecs.getincrementaldecoder("utf-8")("ignore"), [], 0
        for data in reader.pieces(path, member):
            held.append(decoder.decode(data))
            size += len(held[-1])
            if size >= chars:
                yield "".join(held)
                held, size = [], 0
        if size:
            yield "".join(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with MemberReader() as reader:
            for batch in batches:
                for path, member in zip(batch.column("path").to_pylist(), _members(batch)):
                    carry = ""
                    try:
                        for text in texts(reader, path, member):
                            yield pa.RecordBatch.from_pydict({"path": [path], "chunk": [carry + text]})
                            carry = text[-overlap:]
                    except FAULTS:
                        continue

    wanted = files.select("path", *(c for c in ("member",) if c in files.columns))
    return _placed(wanted).mapInArrow(run, "path string, chunk string")
