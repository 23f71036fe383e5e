"""Pattern packing by non-negative least squares.

Documents become pieces of at most one sequence. Patterns are all combinations of up to
three piece lengths that fill a sequence exactly; how often each is used is fitted to the
histogram of lengths by non-negative least squares, rounded down, and what the patterns leave
over is packed best-fit, still on counts of lengths. All of this works on the histogram,
which has as many entries as a sequence has tokens, however many documents there are. Then
every piece finds its place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelake.llm.common import stored
from filelake.llm.tokens import encoder

CAPACITY = 1024
# Shares of the fitted repeats that are tried; 0 leaves all pieces to best-fit.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.0)
_PIECES = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, local long"


class Pattern(NamedTuple):
    lengths: tuple[int, ...]
    repeats: int


def enumerate_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All ``a >= b >= c`` with ``a + b + c = capacity``, each a given length or (b, c) 0 for none."""
    known = np.zeros(capacity + 1, bool)
    known[lengths] = True
    known[0] = True
    a, b = np.meshgrid(np.flatnonzero(known[1:]) + 1, np.flatnonzero(known), indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = capacity - a - b
    good = (c >= 0) & (b <= a) & (c <= b)
    a, b, c = a[good], b[good], c[good]
    return np.stack([a, b, c], 1)[known[c]]


def fit_patterns(histogram: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Repeats x >= 0 that minimise ``|A x - histogram|^2``, by coordinate descent along the steepest coordinate.

    A step changes the residual of at most three lengths, so only the patterns with one of
    them are looked at again. It ends when no step would place half a sequence, or after as
    many steps as there are patterns.
    """
    residual = histogram.astype(float)
    residual[0] = 0.0
    repeats = np.zeros(len(patterns))
    if not len(patterns):
        return repeats
    a, b, c = patterns.T
    # A length that a pattern has k times counts k * k in its norm; 0 is no length.
    same_ab, same_bc, real_b, real_c = a == b, b == c, b > 0, c > 0
    norm = 1.0 + real_b + real_c + 2.0 * (same_ab & real_b) + 2.0 * (same_bc & real_c) + 2.0 * ((a == c) & real_c)
    order = np.argsort(patterns, axis=None, kind="stable")
    edges = np.searchsorted(patterns.ravel()[order], np.arange(len(histogram) + 1))
    holders = order // 3
    slope = residual[a] + residual[b] * real_b + residual[c] * real_c
    gain = np.maximum(slope / norm, 0.0)
    gain *= gain * norm
    for _ in range(len(patterns)):
        best = int(gain.argmax())
        move = max(slope[best] / norm[best], -repeats[best])
        if abs(move) < 0.5:
            break
        repeats[best] += move
        for v in patterns[best]:
            if v:
                residual[v] -= move
        for v in set(patterns[best].tolist()) - {0}:
            near = holders[edges[v] : edges[v + 1]]
            slope[near] = residual[a[near]] + residual[b[near]] * real_b[near] + residual[c[near]] * real_c[near]
            step = np.maximum(slope[near] / norm[near], -repeats[near])
            gain[near] = step * step * norm[near]
    return repeats


def best_fit(histogram: np.ndarray, capacity: int) -> list[Pattern]:
    """Longest first, each into the sequence it leaves the least room in; equal sequences are kept as one with a count."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # sorted keys of groups

    def put(lengths: tuple[int, ...], count: int) -> None:
        room = capacity - sum(lengths)
        if room not in groups:
            insort(rooms, room)
        groups.setdefault(room, []).append((lengths, count))

    for length in np.flatnonzero(histogram)[::-1].tolist():
        left = int(histogram[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if left >= each:
                    put((length,) * each, left // each)
                if left % each:
                    put((length,) * (left % each), 1)
                break
            room = rooms[at]
            lengths, count = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = min(room // length, left)
            used = min(count, left // each)
            put((*lengths, *(length,) * each), used)
            if count > used:
                put(lengths, count - used)
            left -= used * each
    return [Pattern(*g) for room in rooms for g in groups[room]]


def _rounded(histogram: np.ndarray, patterns: np.ndarray, repeats: np.ndarray, share: float, capacity: int) -> list[Pattern]:
    """A share of the fitted repeats, rounded down, and what they leave packed best-fit."""
    left = histogram.astype(np.int64)
    chosen: list[Pattern] = []
    wholes = np.floor(repeats * share).astype(np.int64)
    for k in np.argsort(-wholes, kind="stable").tolist():
        wanted = int(wholes[k])
        if not wanted:
            break
        lengths = tuple(v for v in patterns[k].tolist() if v)
        wanted = min(wanted, *(int(left[v]) // lengths.count(v) for v in lengths))
        if wanted:
            chosen.append(Pattern(lengths, wanted))
            for v in lengths:
                left[v] -= wanted
    return chosen + best_fit(left, capacity)


def plan_patterns(histogram: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns and repeats that place every piece of the histogram exactly once.

    Exact patterns spend short pieces that long ones may need as partners. So several shares
    of the fit are tried, down to none, and the plan of fewest sequences is taken: it never
    has more than best-fit over all pieces.
    """
    patterns = enumerate_patterns(np.flatnonzero(histogram), capacity)
    repeats = fit_patterns(histogram.astype(np.int64), patterns)
    plans = [_rounded(histogram, patterns, repeats, share, capacity) for share in SHARES]
    return min(plans, key=lambda plan: sum(p.repeats for p in plan))


class Places:
    """For a length and a rank within it: the sequence and the offset."""

    def __init__(self, plan: list[Pattern], capacity: int):
        self.first = np.zeros(capacity + 2, np.int64)
        rows: list[tuple[int, int, int, int]] = []  # length, repeats, first sequence, offset
        base = 0
        for p in plan:
            offset = 0
            for v in p.lengths:
                rows.append((v, p.repeats, base, offset))
                offset += v
            base += p.repeats
        self.sequences = base
        rows.sort(key=lambda r: r[0])
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.first = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        self.begin = np.concatenate(([0], np.cumsum(table[:, 1])))  # slots before each row, over all lengths
        self.base, self.offset = table[:, 2], table[:, 3]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self.begin[self.first[length]] + rank
        row = np.searchsorted(self.begin, slot, side="right") - 1
        return self.base[row] + slot - self.begin[row], self.offset[row]


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of all documents; ``local`` counts the pieces of a length within the task ``part`` that cut them."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.encode(batch.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                edges = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for piece, (start, end) in enumerate(zip(edges, edges[1:])):
                    row = (doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes()), int(seen[end - start]))
                    seen[end - start] += 1
                    for column, value in zip(columns, row):
                        column.append(value)
            arrays = [pa.array([part] * len(columns[0]), pa.int32())]
            arrays += [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "doc_id", "piece", "start", "length", "ids_crc32", "local"])

    return docs.select("doc_id", "text").mapInArrow(task, _PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pack every ``docs (doc_id, text)`` into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Only
    documents longer than a sequence are cut, and then the first piece takes the remainder.
    NULL and empty texts are the end id alone; repeated rows are packed once each; an empty
    table gives no row; other columns are ignored.
    """
    # Written once: ranks within a task hold only for the run that gave them.
    pieces = stored(cut_pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["count"]
    places = Places(plan_patterns(histogram, capacity), capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            arrays = [*(batch.column(n) for n in names), *map(pa.array, found)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select(*names, (F.col("base") + F.col("local")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(task, schema)
