"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-grams.

1. Every n-gram of every document is counted over all documents, in sorted blocks
   (:mod:`filelake.llm.counts`). A document keeps the n-grams it shares with any other; the
   rest cannot add to an overlap.
2. Size-derived bounds: a partner must share ``ceil(t * n)`` of a document's ``n`` n-grams, so
   with n-grams in order of rising frequency two partners have one of their first
   ``n - ceil(t * n) + 1`` in common. Documents that meet there form candidate clusters.
3. Documents of a cluster, one for each set of n-grams, are cut into blocks. Each pair of
   blocks is one product of incidence matrices, accumulated over slices of the n-grams, which
   gives all overlaps of the two blocks; pairs below the bound of their sizes fall.
4. Links become components. A block pair returns links to the least document of each group it
   sees, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelake.llm import counts, hashing
from filelake.llm.common import stored
from filelake.operators.components import connected_components
from filelake.operators.skew import pair_tasks
from filelake.session import cut_lineage

WORDS = 5
PERCENT = 75
# N-grams are compared by so many bits; two different ones of two documents are taken for
# equal with odds of 2^-48.
BITS = 48
BLOCK_DOCS = 512
_COLUMNS = 2048
HOT_ROWS = 100_000


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Rising hashes of the distinct n-grams of each text; one for a text of fewer words, none without words."""
    parts = [(t or "").encode() for t in texts]
    lengths = np.array([len(p) + 1 for p in parts], np.int64)
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    h, starts = hashing.word_hashes(data)
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    grams = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - words + 1 + k]
    grams = hashing.mix(grams)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            sets.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            sets.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def _needed(n: np.ndarray | int, percent: int):
    return -(-percent * n // 100)


def _ask_task(buckets: int, words: int):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for chunk, table in counts.chunked(batches, part):
            sets: list[np.ndarray] = []
            for batch in table.to_batches():
                sets += shingle_sets(batch.column("text").to_pylist(), words)
            ids = table.column("doc_id").to_pylist()
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<u8")
            sizes = np.array([len(s) for s in sets], np.int64)
            values = np.concatenate(sets) >> np.uint64(64 - BITS) << np.uint64(64 - BITS)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
            order, starts = counts.distinct_pairs(values)
            many = np.diff(np.append(starts, len(values)))
            multi = np.flatnonzero(many > 1)
            owner = owner[order]
            # The one document of an n-gram travels with it; several are noted by its place.
            note = counts.pack(
                np.array([i is None for i in ids], np.uint8), np.array([i or 0 for i in ids], np.int64), sizes, digests,
                owner[np.repeat(many > 1, many)], multi.astype(np.uint32), many[multi].astype(np.uint32),
            )
            yield counts.ask(chunk, buckets, values[order][starts], None, many, note, carry=owner[starts])

    return task


_SIGNATURE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_shingles", pa.int64()),
        ("digest", pa.binary()),
        ("shared", pa.binary()),
        ("prefix", pa.list_(pa.struct([("gram", pa.int64()), ("df", pa.int64())]))),
    ]
)


def _signatures(percent: int):
    def chunk(table: pa.Table) -> pa.Table:
        heard = counts.answers_of(table)
        empty, ids, sizes, digests, owner, multi, many = counts.unpack(heard.note)
        # Answered n-grams of one document, and those of several, which are all answered.
        single = ~np.isin(heard.places, multi)
        at = np.searchsorted(heard.places, multi)
        doc = np.concatenate((heard.carry[single], owner.astype(np.int64)))
        value = np.concatenate((heard.values[single], np.repeat(heard.values[at], many)))
        freq = np.concatenate((heard.info[single], np.repeat(heard.info[at], many)))
        by_value = np.argsort(value, kind="stable")
        doc, value, freq = doc[by_value], value[by_value], freq[by_value]
        by_doc = np.argsort(doc, kind="stable")  # values stay in rising order within a document
        doc, value, freq = doc[by_doc], value[by_doc], freq[by_doc]
        edges = np.searchsorted(doc, np.arange(len(ids) + 1))
        rows = []
        for k in range(len(ids)):
            a, b, n = edges[k], edges[k + 1], int(sizes[k])
            rest = n - _needed(n, percent) + 1 - (n - (b - a)) if n else 0
            prefix = []
            if rest > 0:
                first = np.argsort(freq[a:b], kind="stable")[:rest] + a
                prefix = [{"gram": g, "df": f} for g, f in zip(value[first].view(np.int64).tolist(), freq[first].tolist())]
            rows.append(
                {
                    "doc_id": None if empty[k] else int(ids[k]), "n_shingles": n, "digest": digests[2 * k : 2 * k + 2].tobytes(),
                    "shared": counts.pack_sorted(value[a:b]).tobytes() if rest > 0 else b"", "prefix": prefix,
                }
            )
        return pa.Table.from_pylist(rows, _SIGNATURE)

    return chunk


def document_signatures(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: the size and digest of its set, the n-grams it shares and those candidates meet on.

    Documents whose n-grams that count are all their own have an empty ``prefix`` and no partner.
    """
    rows = docs.select("doc_id", "text")
    buckets = counts.bucket_count(counts.text_bytes(rows) // 6)
    asked = rows.mapInArrow(_ask_task(buckets, words), counts.ASKED)
    answered = counts.answer(asked, lambda total, distinct, first: np.where(total > 1, total, 0), with_values=True)
    schema = "doc_id long, n_shingles long, digest binary, shared binary, prefix array<struct<gram:long,df:long>>"
    return answered.groupBy("chunk").applyInArrow(_signatures(percent), schema)


def candidate_edges(sets: DataFrame) -> DataFrame:
    """Pairs ``src, dst`` that tie all documents with a common n-gram in their prefixes together.

    Documents of an n-gram are chained in order of id; a frequent n-gram is cut into slices,
    each with its own chain, and the first documents of the slices are chained as well.
    """
    rows = sets.select("doc_id", F.explode("prefix").alias("p")).select("doc_id", "p.gram", "p.df")
    slices = F.ceil(F.col("df") / F.lit(HOT_ROWS)).cast("int")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id"), slices).cast("int"))
    chain = Window.partitionBy("gram", "slice").orderBy("doc_id")
    linked = rows.withColumn("before", F.lag("doc_id").over(chain))
    heads = linked.where("before is null and df > " + str(HOT_ROWS))
    across = heads.withColumn("before", F.lag("doc_id").over(Window.partitionBy("gram").orderBy("doc_id")))
    edges = linked.select("doc_id", "before").unionByName(across.select("doc_id", "before"))
    return edges.where("before is not null and before <> doc_id").select(F.col("before").alias("src"), F.col("doc_id").alias("dst")).distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common n-grams of every left and right set: the product of two 0/1 matrices, slice by slice of their columns."""
    def entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (va, da), (vb, db) = entries(left), entries(right)
    both = np.intersect1d(va, vb)
    ca, cb = np.searchsorted(both, va), np.searchsorted(both, vb)
    ka, kb = np.isin(va, both, kind="sort"), np.isin(vb, both, kind="sort")
    ca, da, cb, db = ca[ka], da[ka], cb[kb], db[kb]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(both), _COLUMNS):
        a, b = np.zeros((len(left), _COLUMNS), np.float32), np.zeros((len(right), _COLUMNS), np.float32)
        ina, inb = (ca >= start) & (ca < start + _COLUMNS), (cb >= start) & (cb < start + _COLUMNS)
        a[da[ina], ca[ina] - start] = 1.0
        b[db[inb], cb[inb] - start] = 1.0
        out += a @ b.T
    return out


def _least_labels(linked: np.ndarray) -> np.ndarray:
    """Of a symmetric 0/1 matrix: for every row the least row reachable."""
    labels = np.arange(len(linked))
    while True:
        near = np.where(linked, labels[None, :], len(labels)).min(1, initial=len(labels))
        new = np.minimum(labels, near)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _multiply(percent: int):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("links", pa.int64())])

    def block_pair(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["doc_id"])
        lo, hi = rows[0]["lo"], rows[0]["hi"]
        left = [r for r in rows if r["block"] == lo]
        right = [r for r in rows if r["block"] == hi]
        if not left or not right:
            return schema.empty_table()
        na, nb = (np.array([r["n_shingles"] for r in x], np.int64) for x in (left, right))
        wa, wb = (np.array([r["copies"] for r in x], np.int64) for x in (left, right))
        common = overlaps(*([counts.unpack_sorted(np.frombuffer(r["shared"], np.uint8)) for r in x] for x in (left, right)))
        sums = na[:, None] + nb[None, :]
        linked = (100 + percent) * common.round().astype(np.int64) >= percent * sums
        linked &= 100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :])
        ids = np.array([r["doc_id"] for r in left] + ([] if lo == hi else [r["doc_id"] for r in right]), np.int64)
        if lo == hi:
            np.fill_diagonal(linked, False)
            square, links = linked, linked @ wb
        else:
            square = np.zeros((len(ids), len(ids)), bool)
            square[: len(left), len(left) :] = linked
            square[len(left) :, : len(left)] = linked.T
            links = np.concatenate((linked @ wb, linked.T @ wa))
        labels = _least_labels(square)
        hit = np.flatnonzero(links)
        # The ids rise within each side only, so the least id of a group is found anew.
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, labels, ids)
        return pa.Table.from_arrays([pa.array(ids[hit]), pa.array(least[labels[hit]]), pa.array(links[hit])], schema=schema)

    return block_pair


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row of ``docs (doc_id, text)``.

    Two documents are linked where 100 * intersection >= ``percent`` * union of their sets of
    word n-grams. Equal sets are one class, of which one document is compared; ``n_links``
    counts the linked documents with all their copies. NULL and empty texts and texts without
    words have the empty set and are linked with nothing; rows of one ``doc_id`` count as one
    document in links; a NULL ``doc_id`` takes the component of its copies or NULL; an empty
    table gives no row; other columns are ignored.
    """
    rows = stored(document_signatures(docs, words, percent), "signatures")
    stats = rows.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("doc_id").alias("copies"))
    stats = cut_lineage(stats.where("rep is not null"))
    # One row per set: the pre-filter leaves the few documents that can have a partner.
    sets = rows.where(F.size("prefix") > 0).join(stats.drop("rep").withColumnRenamed("digest", "d"), F.col("digest") == F.col("d")).drop("d")
    reps = stats.select(F.col("rep").alias("doc_id"), F.col("digest").alias("d"))
    sets = sets.join(reps.withColumnRenamed("doc_id", "r"), (F.col("doc_id") == F.col("r")) & (F.col("digest") == F.col("d")))
    sets = stored(sets.select("doc_id", "digest", "n_shingles", "copies", "shared", "prefix").dropDuplicates(["doc_id", "digest"]), "sets")

    clusters = cut_lineage(connected_components(candidate_edges(sets)))
    placed = sets.drop("prefix").join(clusters.withColumnRenamed("node", "doc_id"), "doc_id")
    tasks = pair_tasks(placed, ["group_id"], "doc_id", "group_size", BLOCK_DOCS)
    columns = ["group_id", "lo", "hi", "block", "doc_id", "n_shingles", "copies", "shared"]
    products = tasks.select(*columns).groupBy("group_id", "lo", "hi").applyInArrow(_multiply(percent), "src long, dst long, links long")
    products = cut_lineage(products)
    links = products.groupBy("src").agg(F.sum("links").alias("links"))
    joined = connected_components(products.select("src", "dst")).select(F.col("node").alias("rep"), F.col("group_id").alias("component"))
    found = stats.join(joined, "rep", "left").join(links.withColumnRenamed("src", "rep"), "rep", "left")
    found = found.select("digest", "copies", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    out = rows.select("doc_id", "n_shingles", "digest").join(found.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("n_shingles") > 0), "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    n_links = F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), n_links.alias("n_links"))
