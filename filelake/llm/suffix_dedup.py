"""Removal of repeated substrings by bucket-pointer refinement of suffixes.

The suffixes of all documents are put into buckets by q-gram and refined until buckets hold
suffixes that agree on the full length (Schuermann and Stoye, "An incomplex algorithm for
fast suffix array construction"). Three things make it fit many machines:

* The bucket identifier of a suffix for a doubled depth comes from its own identifier and the
  one at a later offset, and the new identifiers are used for the next doubling. They are
  hashes, equal for equal strings everywhere, so that refinement needs no exchange within a
  document.
* Suffixes go into blocks: all starts whose string of the full length has the same anchor,
  the least q-gram bucket in it, at about the same offset. A block is known by two
  identifiers: its *core*, in every string of the block, and its *whole* text. A core met
  once ends all suffixes of the block at once, as a bucket of one suffix needs no refinement;
  a whole met twice repeats all of them.
* What is left are blocks of equal core and different wholes, at the ends of repeats. One of
  each whole is refined to single suffixes.

Cores, wholes and suffixes are counted over all documents by :mod:`filelake.llm.counts`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm import counts, hashing
from filelake.llm.common import stored

LENGTH = 400
# The initial buckets' q; a power of two, reached by doubling from single bytes.
GRAM = 64
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def gram_buckets(data: np.ndarray, gram: int) -> np.ndarray:
    """Identifier of the q-gram bucket of every suffix with at least ``gram`` bytes, by doubling from bytes."""
    bucket, depth = hashing.mix(data.astype(np.uint64) + np.uint64(1)), 1
    while depth < gram:
        bucket = (bucket[:-depth] ^ (bucket[:-depth] >> np.uint64(29))) * _SALT + bucket[depth:]
        depth *= 2
    return hashing.mix(bucket)


def _least_in_window(keys: np.ndarray, width: int) -> np.ndarray:
    least, span = keys, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least


def blocks_of(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of one document: first start, number of starts, core and whole identifier."""
    window = length - gram + 1
    half = -(-window // 2)
    grams = gram_buckets(data, gram)
    text = hashing.Substrings(data)
    starts, sizes, anchors, sides = [], [], [], []
    stride = (1 << 20) - window
    for at in range(0, len(grams) - window + 1, stride):
        part = grams[at : at + stride + window - 1]
        # The leftmost of the least: positions fill the low bits.
        keys = (part >> np.uint64(20) << np.uint64(20)) | np.arange(len(part), dtype=np.uint64)
        least = _least_in_window(keys, window)
        anchor = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        side = (anchor - np.arange(len(anchor))) // half
        fresh = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (side[1:] != side[:-1]))))
        starts.append(fresh + at)
        sizes.append(np.diff(np.append(fresh, len(anchor))))
        anchors.append(anchor[fresh] + at)
        sides.append(side[fresh])
    start, size, anchor, side = map(np.concatenate, (starts, sizes, anchors, sides))
    first = anchor - side * half
    core = hashing.mix(text.hash(first, first - half + 1 + length) + side.astype(np.uint64))
    shape = (anchor - start).astype(np.uint64) << np.uint64(32) | size.astype(np.uint64)
    return start, size, core, hashing.mix(text.hash(start, start + size - 1 + length) ^ hashing.mix(shape))


def _documents(table: pa.Table) -> Iterator[tuple[int, str, np.ndarray]]:
    keys = table.column("key").to_pylist()
    for k, text in enumerate(table.column("text").to_pylist()):
        yield k, keys[k], np.frombuffer((text or "").encode(), np.uint8)


def _note(keys: list[str], doc: list[np.ndarray], extra: list[np.ndarray], order: np.ndarray, starts: np.ndarray) -> bytes:
    """What a chunk must know again: keys, and for its entries in sorted order the document and ``extra``."""
    many = np.diff(np.append(starts, len(order)))
    multi = np.flatnonzero(many > 1)
    columns = [counts.pack_bits(c[order]) for c in (doc, *extra)]
    names = np.frombuffer("\n".join(keys).encode(), np.uint8)
    return counts.pack(names, np.array([len(starts)], np.int64), multi.astype(np.uint32), many[multi].astype(np.uint32), *columns)


def _entries(note: bytes, places: np.ndarray, info: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Answered entries: keys, whether an entry is the first of its value, its answer, and its columns."""
    names, distinct, multi, many, *columns = counts.unpack(note)
    columns = [counts.unpack_bits(c) for c in columns]
    per = np.ones(int(distinct[0]), np.int64)
    per[multi] = many
    ends = np.cumsum(per)
    each = per[places]
    within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    held = np.repeat(ends[places] - each, each) + within
    return names.tobytes().decode().split("\n"), within == 0, np.repeat(info, each), [c[held].astype(np.int64) for c in columns]


def _ask_blocks(buckets: int, length: int, gram: int):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for chunk, table in counts.chunked(batches, part):
            keys, found = [], []
            for _, key, data in _documents(table):
                if len(data) >= length:
                    found.append(blocks_of(data, length, gram))
                    keys.append(key)
            if not found:
                continue
            start, size, core, whole = (np.concatenate([f[i] for f in found]) for i in range(4))
            doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            order, firsts = counts.distinct_pairs(core, whole)
            note = _note(keys, doc, [start, size], order, firsts)
            many = np.diff(np.append(firsts, len(order)))
            yield counts.ask(chunk, buckets, core[order][firsts], whole[order][firsts], many, note)

    return task


_REPEATED, _REFINE, _OPEN = 1, 2, 4


def _choose_blocks(total: np.ndarray, distinct: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Wholes met twice are settled; one of each whole goes on where the core has several, and is open if met once."""
    repeated = total > 1
    refine = (distinct > 1) & (first | ~repeated)
    return _REPEATED * repeated + _REFINE * refine + _OPEN * (refine & ~repeated)


_SPANS = pa.schema([("key", pa.string()), ("spans", pa.binary()), ("refine", pa.binary())])


def _settle_blocks(length: int):
    def chunk(table: pa.Table) -> pa.Table:
        heard = counts.answers_of(table)
        keys, lead, flags, (doc, start, size) = _entries(heard.note, heard.places, heard.info)
        rows = []
        repeated = (flags & _REPEATED) > 0
        refine = ((flags & _REFINE) > 0) & lead
        for k in np.unique(doc[repeated | refine]).tolist():
            own, again = repeated & (doc == k), refine & (doc == k)
            spans = merge(start[own], start[own] + size[own] - 1 + length)
            work = np.stack([start[again], size[again], (flags[again] & _OPEN) > 0], 1).astype("<i8")
            rows.append({"key": keys[k], "spans": spans.astype("<i8").tobytes(), "refine": work.tobytes()})
        return pa.Table.from_pylist(rows, _SPANS)

    return chunk


def merge(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Union of half-open intervals as sorted disjoint rows ``[start, end)``; touching ones become one."""
    if not len(start):
        return np.empty((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return np.stack([start[fresh], reach[np.append(fresh[1:] - 1, len(reach) - 1)]], 1)


def _ask_suffixes(buckets: int, length: int):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for chunk, table in counts.chunked(batches, part):
            refine = table.column("refine").to_pylist()
            keys, found, docs = [], [], []
            for k, key, data in _documents(table):
                text, work = hashing.Substrings(data), np.frombuffer(refine[k], "<i8").reshape(-1, 3)
                at = np.repeat(work[:, 0] - np.cumsum(work[:, 1]) + work[:, 1], work[:, 1]) + np.arange(work[:, 1].sum())
                # A start that is already settled in an equal whole is only there to be met.
                found.append((text.hash(at, at + length), at, np.repeat(work[:, 2], work[:, 1])))
                docs.append(len(keys))
                keys.append(key)
            value, at, is_open = (np.concatenate([f[i] for f in found]) for i in range(3))
            doc = np.repeat(docs, [len(f[0]) for f in found])
            order, firsts = counts.distinct_pairs(value)
            note = _note(keys, doc, [at, is_open], order, firsts)
            many = np.diff(np.append(firsts, len(order)))
            yield counts.ask(chunk, buckets, value[order][firsts], None, many, note)

    return task


def _settle_suffixes(length: int):
    def chunk(table: pa.Table) -> pa.Table:
        heard = counts.answers_of(table)
        keys, _, _, (doc, at, is_open) = _entries(heard.note, heard.places, heard.info)
        doc, at = doc[is_open > 0], at[is_open > 0]
        rows = []
        for k in np.unique(doc).tolist():
            own = at[doc == k]
            rows.append({"key": keys[k], "spans": merge(own, own + length).astype("<i8").tobytes(), "refine": b""})
        return pa.Table.from_pylist(rows, _SPANS)

    return chunk


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of id and text: rows alike in both share it, and their repeats are the same."""
    text = F.coalesce("text", F.lit(""))
    ident = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    return docs.select("doc_id", text.alias("text"), F.sha1(ident.cast("binary")).alias("key"))


_WORK = "key string, spans binary, refine binary"


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``key, spans``: per document of :func:`_keyed` rows the byte ranges that some repeated string covers, several rows a key."""
    size = counts.text_bytes(docs)
    asked = docs.select("key", "text").mapInArrow(_ask_blocks(counts.bucket_count(size // 100), length, gram), counts.ASKED)
    answered = counts.answer(asked, _choose_blocks, with_values=False)
    settled = stored(answered.groupBy("chunk").applyInArrow(_settle_blocks(length), _WORK), "blocks")

    work = settled.where(F.octet_length("refine") > 0).select("key", "refine")
    total = work.agg(F.sum(F.octet_length("refine").cast("long"))).first()[0] or 0
    # A key of several equal rows is refined once: its work is one row, its text one of them.
    texts = docs.select("key", "text").join(work, "key").dropDuplicates(["key", "refine"])
    buckets = counts.bucket_count(total // 24 * (length - gram + 1) // 4)
    asked = texts.mapInArrow(_ask_suffixes(buckets, length), counts.ASKED)
    answered = counts.answer(asked, lambda total, distinct, first: total > 1, with_values=False)
    refined = answered.groupBy("chunk").applyInArrow(_settle_suffixes(length), _WORK)
    return settled.select("key", "spans").unionByName(refined.select("key", "spans")).where(F.octet_length("spans") > 0)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            data = text.encode()
            parts = [np.frombuffer(s, "<i8").reshape(-1, 2) for s in spans or []]
            cut = merge(*np.concatenate(parts).T) if parts else np.empty((0, 2), np.int64)
            edges = [0, *cut.ravel().tolist(), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            values = (len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept)
            for column, value in zip(rows, values):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        arrays = [batch.column("doc_id"), *(pa.array(r, t) for r, t in zip(rows, types))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row of ``docs (doc_id, text)``.

    Every byte goes that lies in a string of ``length`` bytes which starts at any other place
    of any document, overlaps included; all strings are judged on the input. NULL counts as
    empty, texts shorter than ``length`` stay whole, repeated rows of at least that length lose
    everything; an empty table gives no row; other columns are ignored. ``kept`` is the rest as
    bytes, since a cut may part a character.
    """
    rows = _keyed(docs)
    spans = repeated_spans(rows, length, gram).groupBy("key").agg(F.collect_set("spans").alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return rows.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(_cut, schema)
