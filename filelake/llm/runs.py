"""Runs (maximal periodic stretches of words) by the branching-tandem test on suffix arrays.

Every run ends in a square ``ww`` whose two halves part right after it, a branching tandem
repeat: of the two suffixes that start with ``w``, one lies in another child of the LCP
interval of depth ``|w|`` than the other (Abouelhoda, Kurtz and Ohlebusch, "Replacing suffix
trees with enhanced suffix arrays"). So for each interval of depth d the suffixes of all
children but the largest are taken, and the inverse suffix array tells whether suffix i+d or
i-d lies in the interval. The squares found are rotated to both sides as far as they go, and
those of one stretch become one run of the least period. Intervals are pairs of nearest
smaller values in the LCP array; no tree is built.

A run of at least ``periods`` periods has as many suffixes in its interval. Groups of fewer
are not refined further, which leaves the rest of the array as it would be.

Many documents share one array: suffixes are ordered within their document alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PERIODS = 4
MIN_LENGTH = 6
# Words whose suffixes are sorted together; a longer document is alone.
BATCH_WORDS = 400_000
_STRIP = 64


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new value starts in sorted keys."""
    fresh = np.ones(len(sorted_keys), bool)
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(fresh)


def _suffix_array(words: np.ndarray, doc: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in groups of at least ``least``, in order, and the classes of all positions by their first 1, 2, 4, ... words.

    Equal classes mean equal words. A class of fewer than ``least`` positions is parted at once.
    """
    n = len(words)
    key = doc * (int(words.max()) + 1) + words if n else words
    order = np.argsort(key, kind="stable")
    first = _groups(key[order])
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    # A class is named by the place of its first member, so that parting it needs no new names elsewhere.
    place = np.arange(n)
    many = np.repeat(size >= least, size)
    rank[order] = np.where(many, np.repeat(first, size), place)
    array, slots = order[many], place[many]
    levels, depth, open_, at = [rank.astype(np.int32) if n < 1 << 31 else rank], 1, array, slots
    where = np.empty(n, np.int64)
    where[at] = np.arange(len(at))
    while len(open_):
        after = open_ + depth
        follow = np.where(after < end[open_], rank[np.minimum(after, n - 1)] + 1, 0)
        lead = rank[open_]
        sort = np.lexsort((follow, lead))
        open_, lead, follow = open_[sort], lead[sort], follow[sort]
        array[where[at]] = open_
        fresh = np.ones(len(open_), bool)
        fresh[1:] = (lead[1:] != lead[:-1]) | (follow[1:] != follow[:-1])
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(open_)))
        many = np.repeat(size >= least, size)
        rank = rank.copy()
        rank[open_] = np.where(many, at[np.repeat(first, size)], at)
        depth *= 2
        # Suffixes that all end before the next words are equal in nothing more.
        open_, at = open_[many], at[many]
        levels.append(rank.astype(levels[0].dtype))
    return array, levels


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many first words two suffixes of one document share, by the classes from the longest down."""
    n, shared = len(end), np.zeros(len(a), np.int64)
    stop = end[a] if len(a) else a
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = (x < stop) & (y < stop)
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        shared += same.astype(np.int64) << k
    return shared


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the last smaller value before each one; the first value must be the least of all."""
    left = np.arange(-1, len(values) - 1)
    left[0] = 0
    todo = np.flatnonzero(values[left] >= values)
    todo = todo[values[todo] > values[0]]
    while len(todo):
        # All between are at least as large, so the same holds beyond them.
        left[todo] = left[left[todo]]
        todo = todo[values[left[todo]] >= values[todo]]
    return left


def _squares(array: np.ndarray, lcp: np.ndarray, n: int, most: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of branching squares. ``most`` bounds the half length per position."""
    size = len(array)
    values = np.concatenate((lcp, [0]))  # the first is 0 as well
    left = _nearest_smaller(values)[:size]
    right = size - _nearest_smaller(values[::-1])[:0:-1]
    at = np.flatnonzero((lcp > 0) & (right - left >= least) & (lcp <= most[array]))
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low, high, depth = left[at], right[at], lcp[at]
    sort = np.lexsort((at, depth, low))
    at, low, high, depth = at[sort], low[sort], high[sort], depth[sort]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])
    heads = np.flatnonzero(new)
    # Children: from the interval's start to its first boundary, and from each boundary to the next.
    start = np.concatenate((low[heads], at))
    stop_after = np.where(np.append(new[1:], True), high, np.append(at[1:], 0))
    stop = np.concatenate((at[heads], stop_after))
    interval = np.concatenate((np.arange(len(heads)), np.cumsum(new) - 1))
    length = stop - start
    sort = np.lexsort((start, -length, interval))
    start, stop, interval, length = start[sort], stop[sort], interval[sort], length[sort]
    smaller = np.ones(len(start), bool)
    smaller[_groups(interval)] = False
    start, stop, interval, length = start[smaller], stop[smaller], interval[smaller], length[smaller]
    child = np.repeat(np.arange(len(start)), length)
    entry = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + start[child]
    suffix, own = array[entry], heads[interval[child]]
    inverse = np.full(n, -1, np.int64)
    inverse[array] = np.arange(size)
    found = []
    for sign in (1, -1):
        other = suffix + sign * depth[own]
        place = np.where((other >= 0) & (other < n), inverse[np.clip(other, 0, n - 1)], -1)
        hit = (place >= low[own]) & (place < high[own]) & ((place < start[child]) | (place >= stop[child]))
        found.append((np.minimum(suffix, other)[hit], depth[own][hit]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _stretch(words: np.ndarray, at: np.ndarray, period: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on, towards ``stop``, equal those ``period`` further in the text."""
    reach, going = np.zeros(len(at), np.int64), np.arange(len(at))
    offsets = np.arange(_STRIP)
    while len(going):
        place = (at[going] + step * reach[going])[:, None] + step * offsets
        inside = place < stop[going][:, None] if step > 0 else place >= stop[going][:, None]
        safe = np.where(inside, place, 0)
        same = inside & (words[safe] == words[np.where(inside, safe + period[going][:, None], 0)])
        full = same.all(axis=1)
        reach[going] += np.where(full, _STRIP, np.argmin(same, axis=1))
        going = going[full]
    return reach


def _rotated(
    words: np.ndarray, at: np.ndarray, period: np.ndarray, begin: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squares rotated to both sides: start, length and period of their stretches.

    Shorter periods come first. A square inside a stretch whose period divides its own is a
    part of that stretch and needs no rotation.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(at):
        now = period < 2 * period.min()
        a, q = at[now], period[now]
        to_left = _stretch(words, a - 1, q, begin[a], -1)
        to_right = _stretch(words, a + q, q, end[a] - q, 1)
        out.append((a - to_left, to_left + 2 * q + to_right, q))
        start, length, q = out[-1]
        sort = np.argsort(start, kind="stable")
        start, stop, q = start[sort], (start + length)[sort], q[sort]
        # Of the stretches that start so far, the one that reaches furthest.
        furthest = np.maximum.accumulate(stop)
        leader = np.maximum.accumulate(np.where(stop == furthest, np.arange(len(stop)), 0))
        at, period = at[~now], period[~now]
        before = np.searchsorted(start, at, "right") - 1
        holder = leader[np.maximum(before, 0)]
        inside = (before >= 0) & (stop[holder] >= at + 2 * period) & (period % q[holder] == 0)
        at, period = at[~inside], period[~inside]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    start, length, period = (np.concatenate([o[i] for o in out]) for i in range(3))
    return start, length, period


def runs_of(words: np.ndarray, doc: np.ndarray, periods: int = PERIODS, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows ``start, length, period`` in order, of word numbers in documents that lie one after the other."""
    n = len(words)
    if not n:
        return np.empty((0, 3), np.int64)
    bounds = _groups(doc)
    sizes = np.diff(np.append(bounds, n))
    begin, end = np.repeat(bounds, sizes), np.repeat(bounds + sizes, sizes)
    array, levels = _suffix_array(words, doc, end, periods)
    if not len(array):
        return np.empty((0, 3), np.int64)
    lcp = np.zeros(len(array), np.int64)
    near = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]]) + 1
    lcp[near] = _common(levels, array[near - 1], array[near], end)
    at, period = _squares(array, lcp, n, (end - begin) // periods, periods)
    fresh = np.unique(np.stack([at, period], 1), axis=0) if len(at) else np.empty((0, 2), np.int64)
    at, period = fresh[:, 0], fresh[:, 1]
    start, length, period = _rotated(words, at, period, begin, end)
    long = length >= np.maximum(min_length, periods * period)
    start, length, period = start[long], length[long], period[long]
    sort = np.lexsort((period, length, start))
    start, length, period = start[sort], length[sort], period[sort]
    # The same stretch is met with multiples of its least period.
    least = np.ones(len(start), bool)
    least[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[least], length[least], period[least]
    sort = np.lexsort((period, start))
    return np.stack([start[sort], length[sort], period[sort]], 1)


# Of a document's id and number of words: which word stands at each place, or None for the text as it is.
Rewrite = Callable[[int | None, int], "np.ndarray | None"]

_ROWS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batch(ids: list[int | None], texts: list[list[bytes]], periods: int, min_length: int, rewrite: Rewrite | None) -> pa.RecordBatch:
    counts = np.array([len(t) for t in texts], np.int64)
    codes = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    starts = np.cumsum(counts) - counts
    moved = {}
    for k, ident in enumerate(ids):
        source = rewrite(ident, int(counts[k])) if rewrite else None
        if source is not None:
            moved[k] = source
            part = codes[starts[k] : starts[k] + counts[k]]
            codes[starts[k] : starts[k] + counts[k]] = part[source]
    runs = runs_of(codes, np.repeat(np.arange(len(ids)), counts), periods, min_length)
    owner = np.searchsorted(starts, runs[:, 0], "right") - 1
    drop = np.zeros(len(codes) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(drop)[:-1] == 0
    edges = np.searchsorted(owner, np.arange(len(ids) + 1)) if len(runs) else np.zeros(len(ids) + 1, np.int64)
    collapsed = []
    for k, text in enumerate(texts):
        if k in moved:
            text = [text[i] for i in moved[k].tolist()]
        if edges[k] < edges[k + 1]:
            text = [text[i] for i in np.flatnonzero(keep[starts[k] : starts[k] + counts[k]]).tolist()]
        collapsed.append(b" ".join(text))
    local = runs[:, 0] - starts[owner] if len(runs) else runs[:, 0]
    rows = pa.StructArray.from_arrays([pa.array(local), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(_RUN))
    lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows)
    text = pa.array(collapsed, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts), lists, text], ["doc_id", "n_words", "runs", "collapsed"])


def word_runs(docs: DataFrame, periods: int = PERIODS, min_length: int = MIN_LENGTH, rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs (doc_id, text)``.

    Words are what ASCII white space parts, numbered from 0. A run is a stretch of words of
    smallest period ``period`` that cannot be extended and spans ``periods`` periods and
    ``min_length`` words or more; ``runs`` lists all, by start and period. ``collapsed`` has
    the words outside runs and each run's first period, joined by one space; a word goes if
    any run has it after its first period. ``rewrite`` may put other words of a document in
    its places first. NULL counts as empty; a text without words has no runs and collapses
    to the empty text; repeated rows give a row each; NULL ids stay; an empty table gives no
    row; other columns are ignored. Whole documents are handled, one at a time if very long.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # Bytes are parted at ASCII white space alone.
                ids.append(ident)
                texts.append((text or "").encode().split())
                size += len(texts[-1])
                if size >= BATCH_WORDS:
                    yield _batch(ids, texts, periods, min_length, rewrite)
                    ids, texts, size = [], [], 0
        if ids:
            yield _batch(ids, texts, periods, min_length, rewrite)

    return docs.select("doc_id", "text").mapInArrow(task, _ROWS)
