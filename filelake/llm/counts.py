"""Global counts of hashed values, exchanged in sorted blocks instead of rows.

A task reads a run of documents (a *chunk*), and sends its distinct values, sorted and
delta-coded, to buckets by value, with how often each occurs in the chunk. A bucket adds up
the counts of all chunks and answers each chunk with the positions of the values it was
asked to report. What else the chunk has to remember travels along untouched. A value that
occurs in a third of all documents is still one entry per chunk, so no bucket is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Values that meet in one bucket, and so in the memory of one task, on average.
BUCKET_VALUES = 1 << 20
CHUNK_BYTES = 8 << 20

ASKED = "target long, chunk long, first long, body binary"
ANSWERED = "chunk long, first long, body binary"
_ASKED = pa.schema([("target", pa.int64()), ("chunk", pa.int64()), ("first", pa.int64()), ("body", pa.binary())])
_ANSWERED = pa.schema([("chunk", pa.int64()), ("first", pa.int64()), ("body", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, with their types and lengths."""
    head = ";".join(f"{a.dtype.str}{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(2, "little") + head + b"".join(a.tobytes() for a in arrays)


def unpack(data: bytes) -> list[np.ndarray]:
    size = int.from_bytes(data[:2], "little")
    at, arrays = 2 + size, []
    for item in data[2:at].decode().split(";"):
        dtype, count = np.dtype(item[:3]), int(item[3:])
        arrays.append(np.frombuffer(data, dtype, count, at))
        at += count * dtype.itemsize
    return arrays


def pack_bits(values: np.ndarray) -> np.ndarray:
    """Small whole numbers as planes of bytes, the last one of half bytes where that is enough."""
    values = values.astype("<u8")
    bits = int(values.max()).bit_length() if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8)
    parts = [np.frombuffer(len(values).to_bytes(8, "little") + bytes([bits]), np.uint8)]
    parts += [planes[:, k] for k in range(bits // 8 + (bits % 8 > 4))]
    if 0 < bits % 8 <= 4:
        half = np.append(planes[:, bits // 8], np.uint8(0))
        parts.append(half[: len(half) // 2 * 2 : 2] | half[1::2] << 4)
    return np.concatenate(parts)


def unpack_bits(data: np.ndarray) -> np.ndarray:
    count, bits = int.from_bytes(data[:8].tobytes(), "little"), int(data[8])
    planes, at = np.zeros((count, 8), np.uint8), 9
    for k in range(bits // 8 + (bits % 8 > 4)):
        planes[:, k] = data[at : at + count]
        at += count
    if 0 < bits % 8 <= 4:
        half = data[at:]
        planes[:, bits // 8] = np.stack([half & 15, half >> 4], 1).ravel()[:count]
    return planes.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> np.ndarray:
    """Differences of rising 64-bit values as planes of bytes; the highest, which is far from even, is compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    planes = steps.view(np.uint8).reshape(-1, 8)
    top = pa.compress(np.ascontiguousarray(planes[:, width - 1]), codec="zstd", asbytes=True)
    head = len(values).to_bytes(8, "little") + bytes([width]) + len(top).to_bytes(8, "little") + top
    return np.concatenate([np.frombuffer(head, np.uint8), *(planes[:, k] for k in range(width - 1))])


def unpack_sorted(data: np.ndarray) -> np.ndarray:
    count, width, size = (int.from_bytes(data[a:b].tobytes(), "little") for a, b in ((0, 8), (8, 9), (9, 17)))
    planes, at = np.zeros((count, 8), np.uint8), 17 + size
    top = pa.decompress(data[17:at].tobytes(), decompressed_size=count, codec="zstd", asbytes=True)
    planes[:, width - 1] = np.frombuffer(top, np.uint8)
    for k in range(width - 1):
        planes[:, k] = data[at : at + count]
        at += count
    return np.cumsum(planes.view("<u8").ravel(), dtype=np.uint64)


def distinct_pairs(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order of the pairs, and where each distinct pair starts in it."""
    order = np.argsort(a, kind="stable") if b is None else np.lexsort((b, a))
    fresh = np.ones(len(a), bool)
    fresh[1:] = a[order][1:] != a[order][:-1]
    if b is not None:
        fresh[1:] |= b[order][1:] != b[order][:-1]
    return order, np.flatnonzero(fresh)


def ask(
    chunk: int, buckets: int, a: np.ndarray, b: np.ndarray | None, counts: np.ndarray, note: bytes, carry: np.ndarray | None = None
) -> pa.RecordBatch:
    """Rows of one chunk: its distinct pairs ``(a, b)`` in sorted order by bucket of ``a``, and its note to itself.

    ``carry`` holds a small number per pair that comes back with its answer.
    """
    share = (1 << 64) // buckets + 1
    edges = np.searchsorted(a, np.array([min(k * share, (1 << 64) - 1) for k in range(1, buckets)], np.uint64))
    edges = [0, *edges.tolist(), len(a)]
    rows: list[tuple] = []
    for k, (start, end) in enumerate(zip(edges, edges[1:])):
        if start < end:
            many = np.flatnonzero(counts[start:end] > 1)
            second = np.empty(0, np.uint64) if b is None else b[start:end]
            own = np.empty(0, np.uint8) if carry is None else pack_bits(carry[start:end])
            body = pack(pack_sorted(a[start:end]), second, many.astype(np.uint32), counts[start:end][many].astype(np.uint32), own)
            rows.append((k, chunk, start, body))
    rows.append((-1 - chunk, chunk, -1, note))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_ASKED)], schema=_ASKED)


# Of every entry: the pair's count in all chunks, the distinct ``b`` of its ``a``, and whether
# it is the pair's first entry; gives a number to answer with, or 0 for no answer.
Choice = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def answer(asked: DataFrame, choose: Choice, with_values: bool) -> DataFrame:
    """Add up all chunks and answer them: rows ``chunk, first, body`` for :func:`answers_of`."""

    def bucket(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "first", "body"))), key=lambda r: r[:2])
        if rows[0][1] < 0:  # a note passes through
            return pa.Table.from_pylist([dict(zip(("chunk", "first", "body"), r)) for r in rows], _ANSWERED)
        parts = [unpack(r[2]) for r in rows]
        values = [unpack_sorted(p[0]) for p in parts]
        a = np.concatenate(values)
        b = np.concatenate([p[1] for p in parts]) if any(len(p[1]) for p in parts) else None
        counts = np.ones(len(a), np.int64)
        ends = np.cumsum([len(v) for v in values])
        for p, end, v in zip(parts, ends, values):
            counts[end - len(v) + p[2].astype(np.int64)] = p[3]
        order, starts = distinct_pairs(a, b)
        sizes = np.diff(np.append(starts, len(a)))
        total = np.empty(len(a), np.int64)
        total[order] = np.repeat(np.add.reduceat(counts[order], starts), sizes)
        first = np.zeros(len(a), bool)
        first[order[starts]] = True
        distinct = np.ones(len(a), np.int64)
        if b is not None:
            heads = a[order[starts]]
            groups = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1])))
            per_pair = np.repeat(np.diff(np.append(groups, len(heads))), np.diff(np.append(groups, len(heads))))
            distinct[order] = np.repeat(per_pair, sizes)
        info = choose(total, distinct, first).astype(np.uint32)
        out = []
        for (chunk, offset, _), end, v, p in zip(rows, ends, values, parts):
            own = info[end - len(v) : end]
            hit = np.flatnonzero(own)
            if len(hit):
                carry = pack_bits(unpack_bits(p[4])[hit]) if len(p[4]) else p[4]
                places = pack_sorted((hit + offset).astype(np.uint64))
                body = pack(places, pack_bits(own[hit]), pack_sorted(v[hit]) if with_values else np.empty(0, np.uint8), carry)
                out.append({"chunk": chunk, "first": offset, "body": body})
        return pa.Table.from_pylist(out, _ANSWERED)

    return asked.groupBy("target").applyInArrow(bucket, ANSWERED)


class Answers(NamedTuple):
    """What one chunk hears: its number and note, and per answered pair, in rising order, place, answer, value and carried number."""

    chunk: int
    note: bytes
    places: np.ndarray
    info: np.ndarray
    values: np.ndarray
    carry: np.ndarray


def answers_of(table: pa.Table) -> Answers:
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "first", "body"))), key=lambda r: r[1])
    parts = [unpack(r[2]) for r in rows if r[1] >= 0]

    def joined(i: int, read: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint64), *(read(p[i]) for p in parts if len(p[i]))])

    places, info = joined(0, unpack_sorted).astype(np.int64), joined(1, unpack_bits).astype(np.int64)
    return Answers(rows[0][0], rows[0][2], places, info, joined(2, unpack_sorted), joined(3, unpack_bits).astype(np.int64))


def bucket_count(values: int) -> int:
    return max(1, -(-values // BUCKET_VALUES))


def chunked(batches: Iterable[pa.RecordBatch], part: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """Runs of about ``limit`` bytes of a task's rows, with a number no other run has."""
    held, size, seq = [], 0, 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield part << 32 | seq, pa.Table.from_batches(held)
            held, size, seq = [], 0, seq + 1
    if held:
        yield part << 32 | seq, pa.Table.from_batches(held)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
