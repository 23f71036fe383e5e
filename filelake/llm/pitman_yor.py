"""Language-model scores by a hierarchical Pitman-Yor process (Teh, 2006).

Each context, the word before, is a restaurant; its tables are the customers of one parent
restaurant that all contexts share, and the parent's base is uniform over the known words and
one unknown. Every distinct pair (context, word) is a *cell*: how many customers have that
dish, and how they sit at tables. A Gibbs step seats customers again given all others: at a
table of n others in proportion to n - d, at a new one in proportion to
(theta + d * tables of the restaurant) * probability of the dish in the parent. All customers of a cell
are seated again together: only the number of their tables counts elsewhere, and its distribution
is known (Teh, 2006; Buntine and Hutter, 2010). The few cells with very many customers take them off
one by one.

Given the number of tables of its restaurant and the parent's probability of its dish, a cell
does not depend on any other. That is what makes the sampler fit many machines: cells are
dealt out by hash, a frequent context or word is spread over all buckets, and all that moves in
a round are two sums per word, tables as a context and tables as a dish. A bucket works with
the sums of the round before, the usual approximation of distributed Gibbs sampling. Cells of
one customer have one table and never move. Rounds after the burn-in are samples; predictive
probabilities are averaged over them.

Texts are tokenised once and written in chunks of numbered words. Words are told apart by
64-bit hashes, within cells by 48 bits of them. The tasks of each step write their state under
fixed names with the same content on every attempt, so a lost executor costs repeats alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelake.llm.common import open_file_system, shared_folder, stored
from filelake.llm.counts import chunked, pack, pack_bits, pack_sorted, unpack, unpack_bits, unpack_sorted
from filelake.llm.hashing import mix

ROUNDS, BURN_IN = 5, 2
# How often each customer is seated again in a round.
SWEEPS = 1
# With fewer cells than this left, they are walked one by one.
FEW_CELLS = 64
# Cells of up to so many customers draw their number of tables at once; the others step customer by
# customer, since the numbers of ways to seat c customers cost c * c / 2 ratios.
DRAWN = 4096
# Ratios held at a time, which stay in a core's cache, and steps whose chances are drawn at a time.
_HELD = 1 << 16
_WALKED = 1 << 13
STRENGTH = 1.0
# Tokens whose cells, and words of chunks that, meet in one task on average.
BUCKET_TOKENS = 1 << 21
BUCKET_WORDS = 1 << 20

_MESSAGE = pa.schema([("target", pa.int64()), ("source", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
_MESSAGE_DDL = "target long, source long, kind int, body binary"
_CELLS, _WORDS, _STATS, _SEED = range(4)


def _close(*parts: np.ndarray) -> bytes:
    return zstandard.compress(pack(*parts), 3)


def _open(data: bytes) -> list[np.ndarray]:
    return unpack(zstandard.decompress(data))


def _write(folder: str, name: str, data: bytes) -> None:
    """Write a file whole or not at all; attempts at one name have the same content."""
    system, path = open_file_system(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/{name}.{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, f"{path}/{name}")


def _read(folder: str, name: str) -> bytes | None:
    system, path = open_file_system(folder)
    if system.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{path}/{name}") as source:
        return source.read()


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_MESSAGE)], schema=_MESSAGE)


def _of(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """Bodies of one kind by the number of their sender."""
    rows = zip(table.column("kind").to_pylist(), table.column("source").to_pylist(), table.column("body").to_pylist())
    return sorted((source, body) for k, source, body in rows if k == kind)


# Chunks of tokens.


def _tokenise(folder: str):
    """Texts to a file per chunk: word hashes in order, words by their place there, lengths, ids; one row of sizes each."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for chunk, table in chunked(batches, part):
            flat, lengths = [], []
            for text in table.column("text").to_pylist():
                # Bytes are parted at ASCII white space and lower-cased in A-Z alone.
                words = (text or "").encode().lower().split()
                flat += words
                flat.append(b"")  # the end
                lengths.append(len(words) + 1)
            coded = pa.array(flat, pa.binary()).dictionary_encode()
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            tokens = place[coded.indices.to_numpy()]
            learns = np.array(table.column("learns").to_pylist(), np.uint8)
            end = np.array([place[coded.indices[-1].as_py()]], np.int64)
            ids = table.column("doc_id").combine_chunks()
            names = (ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
            _write(folder, f"chunk-{chunk}", _close(pack_sorted(hashes[order]), pack_bits(tokens), pack_bits(np.array(lengths)), learns, end, *names))
            sums = [pa.array([n], pa.int64()) for n in (chunk, len(tokens), len(hashes))]
            yield pa.RecordBatch.from_arrays(sums, ["chunk", "tokens", "words"])

    return task


class Chunk(NamedTuple):
    hashes: np.ndarray
    tokens: np.ndarray
    lengths: np.ndarray
    learns: np.ndarray  # per token
    pairs: np.ndarray  # distinct (context, word) as one number, rising
    pair_of: np.ndarray  # per token
    own: np.ndarray  # training count per pair
    ids: pa.Array


def _chunk(folder: str, number: int) -> Chunk:
    hashes, tokens, lengths, learns, end, ids, missing = _open(_read(folder, f"chunk-{number}"))
    hashes, tokens, lengths = unpack_sorted(hashes), unpack_bits(tokens).astype(np.int64), unpack_bits(lengths).astype(np.int64)
    learns = np.repeat(learns > 0, lengths)
    # An end stands before the first word as well.
    before = np.concatenate((end, tokens[:-1]))
    pairs, pair_of = np.unique(before * len(hashes) + tokens, return_inverse=True)
    own = np.bincount(pair_of[learns], minlength=len(pairs))
    return Chunk(hashes, tokens, lengths, learns, pairs, pair_of, own, pa.array(ids, mask=missing > 0))


def _short(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(16)


def _pair_buckets(chunk: Chunk, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the chunk's pairs in each bucket."""
    short, wide = _short(chunk.hashes), len(chunk.hashes)
    bucket = mix(short[chunk.pairs // wide] * np.uint64(0x9E3779B97F4A7C15) + short[chunk.pairs % wide]) % np.uint64(buckets)
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        if edges[k] < edges[k + 1]:
            yield k, order[edges[k] : edges[k + 1]]


def _word_edges(short: np.ndarray, buckets: int) -> np.ndarray:
    """Where each word bucket starts in rising 48-bit hashes."""
    return np.searchsorted(short, np.array([-(-(k << 48) // buckets) for k in range(buckets + 1)], np.uint64))


def _send_cells(folder: str, buckets: int):
    """Distinct pairs of a chunk with their training counts, to the buckets of cells."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (n for b in batches for n in b.column("chunk").to_pylist()):
            chunk = _chunk(folder, number)
            short, wide = _short(chunk.hashes), len(chunk.hashes)
            rows = []
            for k, places in _pair_buckets(chunk, buckets):
                context, word = short[chunk.pairs[places] // wide], short[chunk.pairs[places] % wide]
                starts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
                many = np.diff(np.append(starts, len(places)))
                plain = word.view(np.uint8).reshape(-1, 8)[:, :6].ravel()
                rows.append((k, number, _CELLS, _close(pack_sorted(context[starts]), pack_bits(many), plain, pack_bits(chunk.own[places]))))
            yield from _messages(rows).to_batches()

    return task


# Cells.


def _collect_cells(folder: str, word_buckets: int):
    """Add up one bucket's cells; answer chunks, ask for the words of cells that can move."""

    def task(table: pa.Table) -> pa.Table:
        bucket = table.column("target")[0].as_py()
        sent = _of(table, _CELLS)
        contexts, words, own = [], [], []
        for _, body in sent:
            heads, many, plain, counts = _open(body)
            contexts.append(np.repeat(unpack_sorted(heads), unpack_bits(many).astype(np.int64)))
            wide = np.zeros((len(plain) // 6, 8), np.uint8)
            wide[:, :6] = plain.reshape(-1, 6)
            words.append(wide.view(np.uint64).ravel())
            own.append(unpack_bits(counts).astype(np.int64))
        ends = np.cumsum([len(o) for o in own])
        context, word, own_all = map(np.concatenate, (contexts, words, own))
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        fresh = np.concatenate(([True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])))
        starts = np.flatnonzero(fresh)
        totals = np.add.reduceat(own_all[order], starts)
        moves = totals >= 2
        number = np.cumsum(moves) - 1
        cell = np.empty(len(order), np.int64)
        cell[order] = np.cumsum(fresh) - 1
        rows, listed = [], []
        for (chunk, _), end, counts in zip(sent, ends, own):
            mine = cell[end - len(counts) : end]
            # Others have no customer but the chunk's own.
            hit = np.flatnonzero((totals[mine] >= 2) | ((totals[mine] == 1) & (counts == 0)))
            places = pack_sorted(hit.astype(np.uint64))
            rows.append((chunk, bucket, _CELLS, _close(places, pack_bits(totals[mine[hit]]))))
            listed += [np.array([chunk], np.int64), places, pack_bits(np.where(moves[mine[hit]], number[mine[hit]] + 1, 0))]
        context, word, customers = context[starts][moves], word[starts][moves], totals[moves]
        # More customers first: those that are seated more often lie together.
        sort = np.argsort(-customers, kind="stable")
        rank = np.empty(len(sort), np.int64)
        rank[sort] = np.arange(len(sort))
        context, word, customers = context[sort], word[sort], customers[sort]
        known = np.unique(np.concatenate((context, word)))
        at_context, at_word = np.searchsorted(known, context), np.searchsorted(known, word)
        _write(folder, f"cells-{bucket}", _close(pack_bits(at_context), pack_bits(at_word), pack_bits(customers), pack_sorted(known)))
        _write(folder, f"asked-{bucket}", _close(pack_bits(rank), *listed))
        as_context, as_word = np.bincount(at_context, minlength=len(known)), np.bincount(at_word, minlength=len(known))
        rows += _to_words(bucket, known, word_buckets, (as_context, as_word), with_words=True)
        found = [int((totals == 1).sum()), int((totals == 2).sum())]
        rows.append((bucket, bucket, _STATS, np.array(found, ">i8").tobytes()))
        return _messages(rows)

    return task


def _to_words(bucket: int, known: np.ndarray, word_buckets: int, values: tuple[np.ndarray, ...], with_words: bool) -> list[tuple]:
    edges = _word_edges(known, word_buckets)
    rows = []
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if a < b:
            head = [pack_sorted(known[a:b])] if with_words else []
            rows.append((k, bucket, _WORDS, _close(*head, *(pack_bits(v[a:b]) for v in values))))
    return rows


class Seats(NamedTuple):
    """Customers at tables: how many tables each cell has, and the tables' sizes, cell by cell."""

    tables: np.ndarray
    sizes: np.ndarray


def expected_seats(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> Seats:
    """A start: about the expected number of tables, of sizes that fall by a power law.

    ``fresh`` is the weight of a new table.
    """
    tables, seated = np.ones(len(customers)), np.ones(len(customers))
    while len(customers) and (seated < customers).any():
        more = np.minimum(np.maximum(1, np.floor(seated * 0.1)), customers - seated)
        tables = tables + more * fresh / (seated - discount * tables + fresh)
        seated = seated + more
    return _spread(np.clip(np.floor(tables + rng.random(len(customers))), 1, customers).astype(np.int64), customers, discount)


def _spread(tables: np.ndarray, customers: np.ndarray, discount: float) -> Seats:
    """Customers at so many tables, of sizes that fall by a power law."""
    first = np.cumsum(tables) - tables
    rank = np.arange(tables.sum()) - np.repeat(first, tables) + 1
    share = rank ** (-1.0 / discount)
    total = np.add.reduceat(share, first) if len(first) else share
    spare = customers - tables
    sizes = 1 + np.floor(share / np.repeat(total, tables) * np.repeat(spare, tables)).astype(np.int64)
    if len(first):
        sizes[first] += customers - np.add.reduceat(sizes, first)
    return Seats(tables, sizes)


def reseat(seats: Seats, customers: np.ndarray, fresh_of, discount: float, sweeps: int, rng: np.random.Generator) -> Seats:
    """Gibbs sweeps: in each, every customer of every cell is taken off its table in turn and seated again.

    ``customers`` falls and is 2 at least. ``fresh_of(change)`` gives the weight of a new table
    after a change in tables, and is linear in it. All cells take a step together; the few with
    very many customers end alone. A step costs the same however many tables a cell has: a table
    of n others is met by way of a random customer, and taken with chance (n - d) / n.
    """
    if not len(customers):
        return seats
    ends = np.cumsum(customers)
    first = ends - customers
    # A cell has as many places for tables as customers; those that are empty lie on its stack.
    rank = np.arange(int(ends[-1])) - np.repeat(first, customers)
    used = rank < np.repeat(seats.tables, customers)
    size = np.zeros(len(rank), np.int64)
    size[used] = seats.sizes
    seat = np.repeat(np.flatnonzero(used), seats.sizes)
    # Seats are kept by table; customers taken off table by table would leave too many tables.
    seat = seat[np.argsort(np.repeat(np.arange(len(customers)), customers) + rng.random(len(seat)))]
    empty, tables = np.zeros(len(rank), np.int64), seats.tables.copy()
    bare = np.flatnonzero(~used)
    empty[bare - np.repeat(seats.tables, customers - seats.tables)] = bare
    turns, step = sweeps * customers, 0
    weight = fresh_of(np.zeros(len(customers), np.int64), len(customers))
    slope = fresh_of(np.ones(len(customers), np.int64), len(customers)) - weight
    # Weight of all tables and a new one: this much, and so much for each table.
    whole, each = customers - 1 + weight - slope * seats.tables, slope - discount
    while (live := int(np.searchsorted(-turns, -step, "left"))) >= FEW_CELLS:  # more turns than steps so far
        begin, many, now = first[:live], customers[:live], tables[:live]
        mine = begin + (step if sweeps == 1 else step % many)
        old = seat[mine]
        size[old] -= 1
        left = np.flatnonzero(size[old] == 0)
        empty[begin[left] + many[left] - now[left]] = old[left]
        now[left] -= 1
        new = rng.random(live) * (whole[:live] + each[:live] * now) >= many - 1 - discount * now
        left = np.flatnonzero(new)
        now[left] += 1
        taken = np.empty(live, np.int64)
        taken[left] = empty[begin[left] + many[left] - now[left]]
        left = np.flatnonzero(~new)
        while len(left):
            other = begin[left] + (rng.random(len(left)) * many[left]).astype(np.int64)
            table = seat[other]
            agreed = (other != mine[left]) & (rng.random(len(left)) * size[table] < size[table] - discount)
            taken[left[agreed]] = table[agreed]
            left = left[~agreed]
        size[taken] += 1
        seat[mine] = taken
        step += 1
    for i in range(live):
        own = slice(int(first[i]), int(ends[i]))
        stack = empty[own][: customers[i] - tables[i]] - own.start
        size[own] = _walk(seat[own] - own.start, size[own], stack, float(weight[i] + slope[i] * (tables[i] - seats.tables[i])), float(slope[i]), discount, range(step, int(turns[i])), rng)
        tables[i] = np.count_nonzero(size[own])
    return Seats(tables, size[size > 0])


def _walk(seat: np.ndarray, size: np.ndarray, empty: np.ndarray, weight: float, slope: float, discount: float, steps: range, rng: np.random.Generator) -> list[int]:
    """The steps of one cell: the sizes of its tables after them."""
    names = list(range(len(seat)))  # customers of one table share its number, which stays in the cache
    seat, size, empty = [names[k] for k in seat.tolist()], size.tolist(), [names[k] for k in empty.tolist()]
    count = len(seat)
    joined = count - 1 - discount * (count - len(empty))
    for begin in range(steps.start, steps.stop, _WALKED):
        part = range(begin, min(steps.stop, begin + _WALKED))
        opens, agrees = rng.random((2, len(part))).tolist()
        others = rng.integers(count, size=len(part)).tolist()
        for step, opened, other, agreed in zip(part, opens, others, agrees):
            mine = step % count
            table = seat[mine]
            size[table] -= 1
            if not size[table]:
                empty.append(table)
                joined += discount
                weight -= slope
            if opened * (joined + weight) >= joined:
                table = empty.pop()
                joined -= discount
                weight += slope
            else:
                table = seat[other]
                while other == mine or agreed * size[table] >= size[table] - discount:
                    other, agreed = int(rng.integers(count)), rng.random()
                    table = seat[other]
            size[table] += 1
            seat[mine] = table
    return size


def draw_tables(customers: np.ndarray, tables: np.ndarray, weight: np.ndarray, slope: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of all cells, drawn given all else: every customer of a cell is seated again.

    ``customers`` falls; ``weight`` is that of a new table at ``tables``, which changes by ``slope`` with each.
    c customers sit at t tables in S(c, t) ways, weighed by the sizes of the tables; S(c + 1, t) =
    S(c, t - 1) + (c - t * d) * S(c, t). Ratios S(c, t) / S(c, t - 1) follow from those for c - 1.
    """
    drawn = np.ones(len(customers), np.int64)
    most = int(customers.max(initial=1))
    edges = np.searchsorted(-customers, -np.arange(most + 2), "left")  # where cells of at most so many customers begin
    steps = np.arange(1.0, most + 1)
    share, ratio = discount * steps, np.empty(0)
    for count in range(2, most + 1):
        others = count - 1
        above, below = np.ones(others), others - share[:others]
        above[:-1] += below[1:] * ratio
        below[1:] += 1.0 / ratio
        ratio = np.divide(above, below, out=above)
        start, end = int(edges[count]), int(edges[count - 1])
        each = max(1, _HELD // count)
        for a in range(start, end, each):
            b = min(end, a + each)
            # One column a cell, from two tables on; one table weighs 1.
            logs = np.log(ratio[:, None] * (weight[a:b] + slope[a:b] * (steps[:others, None] - tables[a:b])))
            np.cumsum(logs, axis=0, out=logs)
            top = np.maximum(logs.max(0), 0.0)
            sums = np.exp(logs - top)
            np.cumsum(sums, axis=0, out=sums)
            one = np.exp(-top)
            chance = rng.random(b - a) * (one + sums[-1]) - one
            drawn[a:b] += (chance >= 0) + (chance >= sums[:-1]).sum(0)
    return drawn


def _large(customers: np.ndarray) -> int:
    """How many of falling numbers of customers are too many to be drawn at once."""
    return int(np.searchsorted(-customers, -DRAWN, "left"))


def seat_again(seats: Seats, customers: np.ndarray, fresh_of, discount: float, rng: np.random.Generator) -> Seats:
    """A round of all cells; ``seats`` has the sizes of tables for the large cells alone. See :func:`reseat`."""
    many = len(customers)
    large = _large(customers)
    few = reseat(Seats(seats.tables[:large], seats.sizes), customers[:large], fresh_of, discount, SWEEPS, rng)
    weight = fresh_of(np.zeros(many, np.int64), many)
    slope = fresh_of(np.ones(many, np.int64), many) - weight
    tables = draw_tables(customers[large:], seats.tables[large:], weight[large:], slope[large:], discount, rng)
    return Seats(np.concatenate((few.tables, tables)), few.sizes)


def first_seats(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> Seats:
    """A start: one table a cell, as the sums before the first round have it, but expected seats in large cells."""
    large = _large(customers)
    few = expected_seats(customers[:large], fresh[:large], discount, rng)
    return Seats(np.concatenate((few.tables, np.ones(len(customers) - large, np.int64))), few.sizes)


def _resized(seats: Seats, customers: np.ndarray) -> Seats:
    """Seats for other numbers of customers: the change is made at the first table, the largest at the start."""
    first = np.cumsum(seats.tables) - seats.tables
    change = customers - np.add.reduceat(seats.sizes, first)
    fits = seats.sizes[first] + change >= 1
    sizes = seats.sizes.copy()
    sizes[first] += np.where(fits, change, 0)
    keep = np.repeat(fits, seats.tables)
    keep[first] = True
    sizes[first[~fits]] = customers[~fits]
    return Seats(np.where(fits, seats.tables, 1), sizes[keep])


class Root(NamedTuple):
    """The parent restaurant as a whole: customers, tables, number of known words, discounts of both levels."""

    customers: int
    tables: int
    words: int
    discount: float
    context_discount: float

    def share(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of a word with ``customers`` at ``tables``."""
        rest = (STRENGTH + self.discount * self.tables) / (self.words + 1)
        return (customers - self.discount * tables + rest) / (STRENGTH + self.customers)


def _seat_cells(folder: str, round_: int, root: Root, word_buckets: int, sampled: bool):
    """One round of a bucket of cells: from sums of its words to new sums."""

    def task(table: pa.Table) -> pa.Table:
        bucket = table.column("target")[0].as_py()
        data = _read(folder, f"cells-{bucket}")
        if data is None:
            return _messages([])
        at_context, at_word, customers, known = _open(data)
        known = unpack_sorted(known)
        at_context, at_word, customers = (unpack_bits(x).astype(np.int64) for x in (at_context, at_word, customers))
        heard = [[unpack_bits(p).astype(np.int64) for p in _open(body)] for _, body in _of(table, _WORDS)]
        restaurant, guests, seated = (np.concatenate([h[i] for h in heard] or [np.empty(0, np.int64)]) for i in range(3))
        chance, open_tables = root.share(guests, seated)[at_word], restaurant[at_context]
        rng = np.random.default_rng([round_, bucket])
        discount = root.context_discount
        if round_ == 1:
            seats = first_seats(customers, (STRENGTH + discount * open_tables) * chance, discount, rng)
            sampled_tables = np.zeros(len(customers), np.int64)
        else:
            tables, sizes, sampled_tables = (unpack_bits(x).astype(np.int64) for x in _open(_read(folder, f"seats-{round_ - 1}-{bucket}")))
            seats = Seats(tables, sizes)

        def fresh(change: np.ndarray, live: int) -> np.ndarray:
            return (STRENGTH + discount * (open_tables[:live] + change)) * chance[:live]

        seats = seat_again(seats, customers, fresh, discount, rng)
        if sampled:
            sampled_tables = sampled_tables + seats.tables
        _write(folder, f"seats-{round_}-{bucket}", _close(pack_bits(seats.tables), pack_bits(seats.sizes), pack_bits(sampled_tables)))
        sums = tuple(np.bincount(at, seats.tables, len(known)).astype(np.int64) for at in (at_context, at_word))
        return _messages(_to_words(bucket, known, word_buckets, sums, with_words=False))

    return task


# Words.


def _send_words(folder: str, cell_buckets: int, word_buckets: int):
    """A chunk's words with their training counts, and how many of its cells have no other customer."""

    def task(table: pa.Table) -> pa.Table:
        number = table.column("target")[0].as_py()
        chunk = _chunk(folder, number)
        wide, single = len(chunk.hashes), chunk.own == 1
        answers = dict(_of(table, _CELLS))
        for k, places in _pair_buckets(chunk, cell_buckets):
            single[places[unpack_sorted(_open(answers[k])[0]).astype(np.int64)]] = False
        lone = chunk.pairs[single]
        counts = np.bincount(chunk.tokens[chunk.learns], minlength=wide)
        values = (counts, np.bincount(lone // wide, minlength=wide), np.bincount(lone % wide, minlength=wide))
        edges = _word_edges(_short(chunk.hashes), word_buckets)
        rows = []
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if a < b:
                rows.append((k, number, _CELLS, _close(pack_sorted(chunk.hashes[a:b]), *(pack_bits(v[a:b]) for v in values))))
        return _messages(rows)

    return task


def _collect_words(folder: str):
    """Add up one bucket's words; remember who asked for which."""

    def task(table: pa.Table) -> pa.Table:
        bucket = table.column("target")[0].as_py()
        sent = [(source, _open(body)) for source, body in _of(table, _CELLS)]
        asked = [(source, _open(body)) for source, body in _of(table, _WORDS)]
        hashes = [unpack_sorted(parts[0]) for _, parts in sent]
        known = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
        counts, lone_context, lone_word, contexts, words = (np.zeros(len(known), np.int64) for _ in range(5))
        chunks, buckets = [], []
        for (source, parts), own in zip(sent, hashes):
            at = np.searchsorted(known, own)
            for sums, part in zip((counts, lone_context, lone_word), parts[1:]):
                sums[at] += unpack_bits(part).astype(np.int64)
            chunks += [np.array([source], np.int64), pack_sorted(at.astype(np.uint64))]
        short = _short(known)
        for source, parts in asked:
            at = np.searchsorted(short, unpack_sorted(parts[0]))
            contexts[at] += unpack_bits(parts[1]).astype(np.int64)
            words[at] += unpack_bits(parts[2]).astype(np.int64)
            buckets += [np.array([source], np.int64), pack_sorted(at.astype(np.uint64))]
        _write(folder, f"words-{bucket}", _close(*(pack_bits(x) for x in (counts, lone_context, lone_word, contexts, words))))
        _write(folder, f"chunks-{bucket}", _close(np.empty(0, np.uint8), *chunks))
        _write(folder, f"buckets-{bucket}", _close(np.empty(0, np.uint8), *buckets))
        customers = lone_word + words
        found = [counts.sum(), (counts > 0).sum(), (customers == 1).sum(), (customers == 2).sum(), customers.sum()]
        return _messages([(bucket, bucket, _STATS, np.array(found, ">i8").tobytes())])

    return task


def _seat_words(folder: str, round_: int, root: Root):
    """One round of a bucket of words: sums of all cells, seats in the parent restaurant, and answers."""

    def task(table: pa.Table) -> pa.Table:
        bucket = table.column("target")[0].as_py()
        data = _read(folder, f"words-{bucket}")
        if data is None:
            return _messages([])
        _, lone_context, lone_word, contexts, words = (unpack_bits(x).astype(np.int64) for x in _open(data))
        asked = _open(_read(folder, f"buckets-{bucket}"))[1:]
        at_of = {int(asked[i][0]): unpack_sorted(asked[i + 1]).astype(np.int64) for i in range(0, len(asked), 2)}
        if round_ > 1:
            contexts, words = np.zeros_like(contexts), np.zeros_like(words)
            for source, body in _of(table, _WORDS):
                parts = _open(body)
                contexts[at_of[source]] += unpack_bits(parts[0]).astype(np.int64)
                words[at_of[source]] += unpack_bits(parts[1]).astype(np.int64)
        restaurant, customers = lone_context + contexts, lone_word + words
        # Words with one customer have one table.
        order = np.argsort(-customers, kind="stable")
        moving = order[customers[order] >= 2]
        rng = np.random.default_rng([round_, bucket, 1])
        rest = 1.0 / (root.words + 1)
        start = np.full(len(moving), (STRENGTH + root.discount * root.tables) * rest)
        if round_ == 1:
            seats = first_seats(customers[moving], start, root.discount, rng)
        else:
            places, tables, sizes = (unpack_bits(x).astype(np.int64) for x in _open(_read(folder, f"parent-{round_ - 1}-{bucket}")))
            seats = _moved(places, Seats(tables, sizes), moving, customers, root.discount)

        def fresh(change: np.ndarray, live: int) -> np.ndarray:
            return (STRENGTH + root.discount * (root.tables + change)) * rest

        seats = seat_again(seats, customers[moving], fresh, root.discount, rng)
        tables = np.minimum(customers, 1)
        tables[moving] = seats.tables
        _write(folder, f"parent-{round_}-{bucket}", _close(pack_bits(moving), pack_bits(seats.tables), pack_bits(seats.sizes)))
        _write(folder, f"sums-{round_}-{bucket}", _close(*(pack_bits(x) for x in (restaurant, customers, tables))))
        rows = [(k, bucket, _WORDS, _close(*(pack_bits(x[at]) for x in (restaurant, customers, tables)))) for k, at in at_of.items()]
        rows.append((bucket, bucket, _STATS, np.array([customers.sum(), tables.sum()], ">i8").tobytes()))
        return _messages(rows)

    return task


def _moved(places: np.ndarray, seats: Seats, moving: np.ndarray, customers: np.ndarray, discount: float) -> Seats:
    """The parent's seats of the last round in this round's order, and with its customers where sizes are kept."""
    tables = np.ones(len(customers), np.int64)
    tables[places] = seats.tables
    ends = np.cumsum(seats.tables)
    held = int(np.searchsorted(ends, len(seats.sizes), "right"))
    sizes_of = dict(zip(places[:held].tolist(), np.split(seats.sizes, ends[:held])))
    own = moving[: _large(customers[moving])]
    parts = [
        sizes_of[place] if place in sizes_of else _spread(np.minimum(tables[[place]], customers[[place]]), customers[[place]], discount).sizes
        for place in own.tolist()
    ]
    if not parts:
        return Seats(tables[moving], np.empty(0, np.int64))
    few = _resized(Seats(np.array([len(p) for p in parts]), np.concatenate(parts)), customers[own])
    return Seats(np.concatenate((few.tables, tables[moving[len(own) :]])), few.sizes)


# Scores.


def _answer_words(folder: str, samples: list[int]):
    """A bucket's words as the chunks know them: training counts, and per sample the sums."""

    def task(table: pa.Table) -> pa.Table:
        bucket = table.column("target")[0].as_py()
        data = _read(folder, f"words-{bucket}")
        if data is None:
            return _messages([])
        counts = unpack_bits(_open(data)[0])
        sums = [unpack_bits(x) for r in samples for x in _open(_read(folder, f"sums-{r}-{bucket}"))]
        chunks = _open(_read(folder, f"chunks-{bucket}"))[1:]
        rows = []
        for i in range(0, len(chunks), 2):
            at = unpack_sorted(chunks[i + 1]).astype(np.int64)
            rows.append((int(chunks[i][0]), bucket, _WORDS, _close(*(pack_bits(x[at]) for x in (counts, *sums)))))
        return _messages(rows)

    return task


def _answer_cells(folder: str, last: int):
    def task(table: pa.Table) -> pa.Table:
        bucket = table.column("target")[0].as_py()
        data = _read(folder, f"cells-{bucket}")
        if data is None:
            return _messages([])
        customers = np.concatenate(([1], unpack_bits(_open(data)[2]).astype(np.int64)))
        # A cell without a number has one customer at one table in every sample.
        sampled = unpack_bits(_open(_read(folder, f"seats-{last}-{bucket}"))[2]).astype(np.int64)
        rank, *listed = _open(_read(folder, f"asked-{bucket}"))
        rank = unpack_bits(rank).astype(np.int64)
        rows = []
        for i in range(0, len(listed), 3):
            number = unpack_bits(listed[i + 2]).astype(np.int64)
            at = np.where(number > 0, rank[number - 1] + 1 if len(rank) else 0, 0)
            tables = np.where(number > 0, sampled[at - 1] if len(sampled) else 0, 0)
            rows.append((int(listed[i][0]), bucket, _CELLS, _close(listed[i + 1], pack_bits(customers[at]), pack_bits(tables))))
        return _messages(rows)

    return task


_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(folder: str, cell_buckets: int, tokens: int, roots: list[Root]):
    def task(table: pa.Table) -> pa.Table:
        number = table.column("target")[0].as_py()
        chunk = _chunk(folder, number)
        wide, samples = len(chunk.hashes), len(roots)
        heard = [[unpack_bits(p).astype(np.int64) for p in _open(body)] for _, body in _of(table, _WORDS)]
        counts, *sums = (np.concatenate([h[i] for h in heard]) for i in range(1 + 3 * samples))
        customers, tables = chunk.own.copy(), np.minimum(chunk.own, 1).astype(float)
        answers = dict(_of(table, _CELLS))
        for k, places in _pair_buckets(chunk, cell_buckets):
            at, total, sampled = _open(answers[k])
            at, total, sampled = places[unpack_sorted(at).astype(np.int64)], unpack_bits(total).astype(np.int64), unpack_bits(sampled)
            customers[at] = total
            tables[at] = np.where(total > 1, sampled / samples, 1.0)
        context, word = chunk.pairs // wide, chunk.pairs % wide
        discount = roots[0].context_discount
        likely = np.maximum(customers - discount * tables, 0)
        for s, root in enumerate(roots):
            restaurant, guests, seated = sums[3 * s : 3 * s + 3]
            likely += (STRENGTH + discount * restaurant)[context] * root.share(guests, seated)[word] / samples
        # Every word of a training text, and every end, is the context of one token.
        logs = np.log10(likely / (STRENGTH + counts[context]))
        vocabulary = roots[0].words
        base = np.log10((counts + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
        first = np.cumsum(chunk.lengths) - chunk.lengths
        add = lambda x: np.add.reduceat(x, first)
        columns = [chunk.lengths, add((counts > 0).astype(np.int64)[chunk.tokens]), add(base[chunk.tokens]), add(logs[chunk.pair_of])]
        return pa.table([chunk.ids, *map(pa.array, columns)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return task


def _discount(once: int, twice: int) -> float:
    """The usual estimate from what was met once and twice."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def score_documents(docs: DataFrame, learns: Column, rounds: int = ROUNDS, burn_in: int = BURN_IN) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs (doc_id, text)``.

    The model learns from the rows where ``learns`` is true (not from NULL). Tokens are the
    words that ASCII white space parts, A-Z in lower case, then one end. ``base_score`` is the
    smoothed unigram log10 probability, ``score`` that of the model. NULL and empty texts have
    the end alone; repeated rows count and are scored each; without training rows every token
    is unknown and scores 0; an empty table gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "pitman-yor")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learns, F.lit(False)).alias("learns"))
    chunks = stored(rows.mapInArrow(_tokenise(folder), "chunk long, tokens long, words long"), "chunks")
    number, tokens, words = chunks.agg(F.count(F.lit(1)), F.sum("tokens"), F.sum("words")).first()
    if not number:
        return spark.createDataFrame([], "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    cell_buckets, word_buckets = -(-tokens // BUCKET_TOKENS), -(-words // BUCKET_WORDS)

    def seeds(count: int) -> DataFrame:
        """Every bucket takes part in every round."""
        ids = F.col("id")
        return spark.range(count).select(ids.alias("target"), ids.alias("source"), F.lit(_SEED).alias("kind"), F.lit(b"").alias("body"))

    def stats(messages: DataFrame, length: int) -> list[int]:
        """Sums of the few numbers each bucket reports."""
        report = [F.conv(F.hex(F.substring("body", 1 + 8 * i, 8)), 16, 10).cast("long") for i in range(length)]
        return [x or 0 for x in messages.where(F.col("kind") == _STATS).agg(*(F.sum(r) for r in report)).first()]

    def step(messages: DataFrame, task) -> DataFrame:
        return messages.groupBy("target").applyInArrow(task, _MESSAGE_DDL)

    sent = chunks.select("chunk").repartition(number).mapInArrow(_send_cells(folder, cell_buckets), _MESSAGE_DDL)
    cells = stored(step(sent, _collect_cells(folder, word_buckets)), "cells")
    once, twice = stats(cells, 2)
    known = step(cells.where(F.col("kind") == _CELLS), _send_words(folder, cell_buckets, word_buckets))
    asked = known.unionByName(cells.where(F.col("kind") == _WORDS))
    train, vocabulary, root_once, root_twice, customers = stats(stored(step(asked, _collect_words(folder)), "words"), 5)
    root = Root(customers, vocabulary, vocabulary, _discount(root_once, root_twice), _discount(once, twice))

    roots, sums = {}, seeds(word_buckets)
    for round_ in range(1, rounds + 2):
        heard = stored(step(sums, _seat_words(folder, round_, root)), f"words-{round_}")
        customers, tables = stats(heard, 2)
        root = roots[round_] = root._replace(customers=customers, tables=tables)
        if round_ <= rounds:
            told = heard.where(F.col("kind") == _WORDS).unionByName(seeds(cell_buckets))
            seated = step(told, _seat_cells(folder, round_, root, word_buckets, round_ > burn_in))
            sums = stored(seated, f"cells-{round_}").unionByName(seeds(word_buckets))
    # The sums of a round are those of the seats of the round before.
    samples = list(range(burn_in + 2, rounds + 2))
    answers = step(seeds(word_buckets), _answer_words(folder, samples)).unionByName(step(seeds(cell_buckets), _answer_cells(folder, rounds)))
    scores = answers.groupBy("target").applyInArrow(_score(folder, cell_buckets, train, [roots[r] for r in samples]), _SCORES)
    return scores.select("doc_id", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")
