"""Length-delimited binary records of token ids, with an offset index beside each file.

A frame is the payload's length (8 bytes), the masked CRC-32C of those bytes (4), the
payload, and its masked CRC-32C (4), all little-endian: the frame of TFRecord files. The
payload is a header (flags, bytes per id, document id) and the ids. The index file has one
fixed entry per record (frame offset, frame length, ids before it in the file), so that any
record, and so any order of records, can be read without a scan.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelake.llm.common import open_file_system, shared_folder
from filelake.llm.tokens import encoder
from filelake.session import cut_lineage

_BLOCK = 4096
# Up to this many bytes a loop is faster than a gather.
_SHORT = 32
_HEAD = struct.Struct("<BBq")  # flags (1: no id), bytes per token id, document id
INDEX_ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8"), ("before", "<u8")])
READ_RECORDS = 4096
READ_BYTES = 16 << 20


@cache
def _crc_table() -> np.ndarray:
    """Row k: what a byte followed by ``_BLOCK - 1 - k`` others adds to the register."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0x82F63B78), byte >> 1)
    rows = np.empty((_BLOCK, 256), np.uint32)
    rows[-1] = byte
    for k in range(_BLOCK - 2, -1, -1):
        rows[k] = (rows[k + 1] >> 8) ^ byte[rows[k + 1] & 0xFF]
    return rows


@cache
def _crc_tables() -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The table as one row, where each of its rows starts, and the row of a last byte."""
    table = _crc_table()
    return table.ravel(), np.arange(_BLOCK, dtype=np.int32) * 256, table[-1].tolist()


def crc32c(data: bytes) -> int:
    """CRC-32C (Castagnoli); the register is linear, so a block is one gather and one XOR over its bytes."""
    flat, rows, single = _crc_tables()
    state = 0xFFFFFFFF
    array = np.frombuffer(data, np.uint8)
    for start in range(0, len(array), _BLOCK):
        size = min(_BLOCK, len(array) - start)
        if size <= _SHORT:
            for b in data[start:]:
                state = (state >> 8) ^ single[(state ^ b) & 0xFF]
            continue
        part = array[start : start + size] + rows[_BLOCK - size :]
        part[:4] = rows[_BLOCK - size : _BLOCK - size + 4] + [array[start + k] ^ (state >> 8 * k & 0xFF) for k in range(4)]
        state = int(np.bitwise_xor.reduce(flat[part]))
    return state ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    """The rotation and offset TFRecord applies, so that checksums of checksums stay useful."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(crc32c(length))), payload, struct.pack("<I", masked(crc32c(payload)))))


def unframe(data: memoryview) -> bytes:
    """The payload of one frame; raises ``ValueError`` if a length or checksum is wrong."""
    if len(data) < 16:
        raise ValueError("frame too short")
    length, check = struct.unpack_from("<QI", data)
    if masked(crc32c(bytes(data[:8]))) != check or length != len(data) - 16:
        raise ValueError("wrong length of a frame")
    payload = bytes(data[12 : 12 + length])
    if masked(crc32c(payload)) != struct.unpack_from("<I", data, 12 + length)[0]:
        raise ValueError("wrong checksum of a frame")
    return payload


def pack_ids(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack(doc_id is None, width, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    empty, width, doc_id = _HEAD.unpack_from(payload)
    return None if empty else doc_id, np.frombuffer(payload, f"<u{width}", offset=_HEAD.size).astype("<u4")


_MANIFEST = "shard int, path string, records long, n_tokens long, bytes long"


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs (doc_id, text)`` in rising ``doc_id`` order; one row per file in the result.

    Rows are dealt out by ranges of ids (NULL first, equal ids by text), and each range is one
    file. A task that runs again writes files of new names; only files in the manifest count.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encode = encoder(tokenizer)
        width = 2 if max(encode.vocabulary, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], f"<u{width}").tobytes()
        out = None
        offset = records = tokens = 0
        entries: list[np.ndarray] = []
        for batch in batches:
            if out is None:
                fs, root = open_file_system(folder)
                fs.create_dir(root)
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec"
                out = fs.open_output_stream(f"{root}/{name}")
                index = fs.open_output_stream(f"{root}/{name}.idx")
            found = encode.encode(batch.column("text").to_pylist())
            entries = np.zeros(len(found), INDEX_ENTRY)
            for k, (doc_id, ids) in enumerate(zip(batch.column("doc_id").to_pylist(), found)):
                data = frame(pack_ids(doc_id, ids, width) + end)
                out.write(data)
                entries[k] = (offset, len(data), tokens)
                offset += len(data)
                tokens += len(ids) + 1
            records += len(found)
            index.write(entries.tobytes())
        if out is not None:
            out.close()
            index.close()
            row = {"shard": [shard], "path": [f"{folder}/{name}"], "records": [records], "n_tokens": [tokens], "bytes": [offset]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("records", "n_tokens", "bytes"))]))

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc()]
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    return cut_lineage(ranged.mapInArrow(task, _MANIFEST))


def read_records(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all records, each read at its place in the index and checked.

    ``start`` counts the ids of all records before it, files in order of their shard: a
    window over one row per file.
    """
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    parts = F.sequence(F.lit(0), F.floor((F.col("records") - 1) / READ_RECORDS).cast("int"))
    count = manifest.agg(F.sum(F.ceil(F.col("records") / READ_RECORDS))).first()[0] or 1
    work = files.select("path", "base", "records", F.explode(parts).alias("part")).repartition(int(count), "path", "part")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_part(row["path"], row["base"], row["part"] * READ_RECORDS, row["records"])

    return work.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_part(path: str, base: int, first: int, records: int) -> Iterator[pa.RecordBatch]:
    folder, _, name = path.rpartition("/")
    fs, root = open_file_system(folder)
    count = min(READ_RECORDS, records - first)
    with fs.open_input_file(f"{root}/{name}.idx") as file:
        if file.size() != records * INDEX_ENTRY.itemsize:
            raise ValueError(f"{path}: index of wrong length")
        entries = np.frombuffer(file.read_at(count * INDEX_ENTRY.itemsize, first * INDEX_ENTRY.itemsize), INDEX_ENTRY)
    with fs.open_input_file(f"{root}/{name}") as file:
        start = 0
        while start < count:
            end = start + 1
            while end < count and entries["offset"][end] + entries["length"][end] - entries["offset"][start] <= READ_BYTES:
                end += 1
            at = int(entries["offset"][start])
            size = int(entries["offset"][end - 1] + entries["length"][end - 1]) - at
            data = memoryview(file.read_at(size, at))
            columns: list[list] = [[], [], [], []]
            for offset, length, before in entries[start:end].tolist():
                doc_id, ids = unpack_ids(unframe(data[offset - at : offset - at + length]))
                for column, value in zip(columns, (doc_id, base + before, len(ids), zlib.crc32(ids.tobytes()))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])
            start = end


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encode ``docs (doc_id, text)``, write records to the shared folder and read them back.

    NULL and empty texts give records of the end id alone; repeated rows are repeated records;
    an empty table gives no file and no row; other columns are ignored.
    """
    folder = shared_folder(docs.sparkSession, "records")
    return read_records(write_records(docs, folder, tokenizer, end_id))
