"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

Distinct vectors are dealt to shards of bounded size and a graph is built in each. Shards and
graphs are written once to the shared folder, and a task reads the one graph and the one block
of vectors it compares, so neither goes through a shuffle or the JVM again. Every vector is
searched in every shard, in blocks of queries, with a beam that is widened until an audit against a scan of the shard finds the recall high enough, and for single
queries until the beam reaches below the threshold and, in its own shard, meets the query
itself; a beam that nears the size of the shard is a scan. What is found is verified in double
precision. A block returns links to the least vector of each group it sees, never all pairs of
a group, and the links are united to components. A link found from one end alone shows in
the signs of both ends; the components it lies in are scanned.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm.common import open_file_system, stored
from filelake.operators import skew
from filelake.operators.components import connected_components
from filelake.session import cut_lineage, shared_folder

COSINE = 0.9
# A search takes steps with the logarithm of a shard and is made once per shard, so shards are
# as large as a task's memory lets them be. Queries of a shard are dealt to several tasks.
SHARD_ROWS = 65_536
QUERY_ROWS = 8192
MAX_TASKS = 20_000  # further pairs of a graph and a block of queries share the tasks
NEIGHBOURS = 16
# A wide beam at the build costs once what it saves every query: the audit then passes narrow beams.
BUILD_BEAM = 128
SEARCH_BEAM = 48
AUDIT_QUERIES = 64
AUDIT_RECALL = 0.99
_MARGIN = 1e-4  # single precision in the search, double in the check
_STEP = 4  # nodes of a beam opened at once, at least; wide beams are opened in about so many steps
_STEPS = 12
_BLOCK = 1024
_CHOICES = 256  # lists chosen anew at once, whose candidates are compared with each other
_BEAMS = 256  # queries searched at once, whose marks and vectors stay in a core's cache
# A beam gathers some 32 nodes for each of its own one by one, which costs as much as a product
# with about this many nodes of the shard in their order.
_SCAN = 512


class Graph(NamedTuple):
    """Unit vectors and, per level from the base up, the neighbours of every node (-1 for none)."""

    unit: np.ndarray
    levels: list[np.ndarray]
    entry: int


def _taken(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The elements ``at`` of every row."""
    return x.ravel().take(at + np.arange(len(x))[:, None] * x.shape[1])


def _cosines(unit: np.ndarray, queries: np.ndarray, query: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Cosines of pairs that lie together by query, whose nodes stay in a core's cache."""
    found = np.empty(len(node), np.result_type(unit, queries))
    edges = [0, *(np.flatnonzero(query[1:] != query[:-1]) + 1).tolist(), len(node)] if len(node) else []
    for a, b in pairwise(edges):
        found[a:b] = unit.take(node[a:b], axis=0) @ queries[query[a]]
    return found


def beam_search(unit: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``width`` nodes of one level for all queries at once, started at ``entries``; ids (-1 for none) and cosines."""
    count = len(queries)
    entries = entries.reshape(count, -1).astype(links.dtype)
    held = max(width, entries.shape[1])
    ids, sims = np.full((count, held), -1, links.dtype), np.full((count, held), -np.inf, np.float32)
    ids[:, : entries.shape[1]] = entries
    sims[:, : entries.shape[1]] = np.where(entries >= 0, np.einsum("bd,bkd->bk", queries, unit[np.maximum(entries, 0)]), -np.inf)
    opened = ids < 0
    # A query and a node in one number, which is also the place of their mark.
    bits = len(unit).bit_length()
    base = np.arange(count, dtype=np.int64) << bits
    visited = np.zeros(count << bits, bool)
    visited[(base[:, None] + entries)[entries >= 0]] = True
    step = min(max(_STEP, width // _STEPS), width)
    active, place = np.arange(count), np.empty(count, np.int64)
    while True:
        mine, own, now = ids[active], sims[active], opened[active]
        waiting = np.where(now, -np.inf, own)
        if held > step:
            pick = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
        else:
            pick = np.broadcast_to(np.arange(held), waiting.shape)
        real = _taken(waiting, pick) > -np.inf
        more = real.any(1)
        if not more.any():
            break
        active, mine, own, now, pick, real = (x[more] for x in (active, mine, own, now, pick, real))
        np.put_along_axis(now, pick, True, 1)
        row, k = np.nonzero(real)
        near = links.take(mine[row, pick[row, k]], axis=0)
        keys = (near + base[active[row]][:, None])[near >= 0]
        keys = keys[~visited.take(keys)]
        keys.sort()  # a sort and a comparison take a fraction of the time of np.unique
        keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
        visited[keys] = True
        query, node = keys >> bits, keys & ((1 << bits) - 1)
        found = _cosines(unit, queries, query, node)
        place[active] = np.arange(len(active))
        row = place[query]
        # What is no better than the last of a full beam would leave it at once.
        good = found > own.min(1)[row]
        row, node, found = row[good], node[good], found[good]
        many = np.bincount(row, minlength=len(active))
        if len(row):
            wide = held + int(many.max())
            at = row * wide + held + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            merged = np.full((len(active), wide), -1, links.dtype), np.full((len(active), wide), -np.inf, np.float32), np.ones((len(active), wide), bool)
            for all_of, old, fresh in zip(merged, (mine, own, now), (node, found, False)):
                all_of[:, :held] = old
                all_of.ravel()[at] = fresh
            keep = np.argpartition(-merged[1], held - 1, axis=1)[:, :held]
            ids[active], sims[active], now = (_taken(x, keep) for x in merged)
        opened[active] = now
    return np.where(sims > -np.inf, ids, -1), sims


def _choose(unit: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, count: int) -> np.ndarray:
    """Per row up to ``count`` neighbours: candidates nearer to the node than to a chosen one, then the nearest left."""
    return np.concatenate([_choose_rows(unit, *(x[k : k + _CHOICES] for x in (own, ids, sims)), count) for k in range(0, len(ids), _CHOICES)])


def _choose_rows(unit: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, count: int) -> np.ndarray:
    order = np.argsort(-sims, axis=1, kind="stable")[:, : 4 * count]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    good = (ids >= 0) & (ids != own[:, None]) & (sims > -np.inf)
    near = unit[np.maximum(ids, 0)]
    mutual = near @ near.transpose(0, 2, 1)
    shaded, taken = ~good, np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        taken[:, k] = ~shaded[:, k]
        shaded |= taken[:, [k]] & (mutual[:, k] >= sims)
    # Chosen ones first, then other good ones, each from the nearest on.
    first = np.argsort(np.where(taken, 0, np.where(good, 1, 2)), axis=1, kind="stable")[:, :count]
    chosen = np.where(np.take_along_axis(good, first, 1), np.take_along_axis(ids, first, 1), -1)
    return np.pad(chosen, ((0, 0), (0, count - chosen.shape[1])), constant_values=-1)


def _link_back(unit: np.ndarray, links: np.ndarray, nodes: np.ndarray, chosen: np.ndarray) -> None:
    """Add ``nodes`` to the lists of their chosen neighbours; lists that would overflow are chosen anew."""
    a, k = np.nonzero(chosen >= 0)
    to, source = chosen[a, k], nodes[a]
    new = (links[to] != source[:, None]).all(1)
    to, source = to[new], source[new]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    targets, first, counts = np.unique(to, return_index=True, return_counts=True)
    width = links.shape[1]
    row = np.repeat(np.arange(len(targets)), counts)
    rank = np.arange(len(to)) - first[row]
    held = (links[targets] >= 0).sum(1)
    over = held + counts > width
    fits = ~over[row]
    links[to[fits], (held[row] + rank)[fits]] = source[fits]
    if not over.any():
        return
    full, place = targets[over], np.cumsum(over) - 1
    keep = over[row] & (rank < 2 * width)
    extra = np.full((len(full), min(int(counts[over].max()), 2 * width)), -1, np.int64)
    extra[place[row[keep]], rank[keep]] = source[keep]
    for k in range(0, len(full), _BLOCK):
        some = full[k : k + _BLOCK]
        ids = np.concatenate((links[some], extra[k : k + _BLOCK]), 1)
        sims = np.where(ids >= 0, np.einsum("bd,bkd->bk", unit[some], unit[np.maximum(ids, 0)]), -np.inf)
        links[some] = _choose(unit, some, ids, sims, width)


def build_graph(unit: np.ndarray, seed: int = 0) -> Graph:
    """Insert all vectors in batches that at most double the graph; levels are drawn geometrically."""
    n = len(unit)
    rng = np.random.default_rng(seed)
    height = np.minimum((-np.log(rng.random(n)) / np.log(NEIGHBOURS)).astype(np.int64), 6)
    order = np.argsort(-height, kind="stable")  # the highest first, so that the entry never changes
    levels = [np.full((n, NEIGHBOURS * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(height.max(initial=0)) + 1)]
    entry, done = int(order[0]), 1
    while done < n:
        batch = order[done : done + min(done, 512)]
        at = np.full((len(batch), 1), entry)
        for level in reversed(range(len(levels))):
            here = height[batch] >= level
            ids, sims = beam_search(unit, levels[level], unit[batch], at, BUILD_BEAM if here.any() else 1)
            at = np.take_along_axis(ids, np.argsort(-sims, 1)[:, :4], 1)
            if here.any():
                nodes = batch[here]
                mates = unit[nodes] @ unit[nodes].T
                ids = np.concatenate((ids[here], np.broadcast_to(nodes, mates.shape)), 1)
                chosen = _choose(unit, nodes, ids, np.concatenate((sims[here], mates), 1), levels[level].shape[1] // (2 if level == 0 else 1))
                levels[level][nodes, : chosen.shape[1]] = chosen
                _link_back(unit, levels[level], nodes, chosen)
        done += len(batch)
    return Graph(unit, levels, entry)


def search_graph(graph: Graph, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.full((len(queries), 1), graph.entry)
    for level in reversed(range(1, len(graph.levels))):
        ids, sims = beam_search(graph.unit, graph.levels[level], queries, at, 4)
        at = np.take_along_axis(ids, np.argsort(-sims, 1)[:, :1], 1)
    return beam_search(graph.unit, graph.levels[0], queries, at, width)


def _in_parts(rows: np.ndarray, width: int, most: int = _BLOCK) -> list[np.ndarray]:
    """Rows in parts that keep a matrix of ``width`` columns below a few million entries."""
    each = max(16, min(most, (1 << 21) // max(1, width)))
    return [rows[k : k + each] for k in range(0, len(rows), each)]


def _audited_width(graph: Graph, queries: np.ndarray, least: float) -> int:
    """The narrowest beam, by quarters wider each time, with which the sample finds its true links and nearest nodes."""
    sample = queries[:: max(1, len(queries) // AUDIT_QUERIES)][:AUDIT_QUERIES]
    truth = sample @ graph.unit.T
    near = truth >= np.minimum(np.partition(truth, -min(10, truth.shape[1]), axis=1)[:, [-min(10, truth.shape[1])]], least)
    width = SEARCH_BEAM
    while 4 * width < len(graph.unit):
        ids, _ = search_graph(graph, sample, width)
        hit = np.zeros(truth.shape, bool)
        a, k = np.nonzero(ids >= 0)
        hit[a, ids[a, k]] = True
        links = truth >= least
        # Links beyond the width of a beam are met by widening single queries, so a beam has to be full of them.
        found, wanted = (hit & links).sum(1), np.minimum(links.sum(1), width)
        if (found >= AUDIT_RECALL * wanted).all() and (hit & near).sum() >= 0.9 * np.minimum(near.sum(1), width).sum():
            break
        width += width // 4
    return width


def linked_pairs(graph: Graph, queries: np.ndarray, threshold: float, own: np.ndarray | None = None, scan: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (query, node) of cosine about ``threshold`` or more, in blocks of queries.

    ``own`` has the node that is the query itself, or -1; ``scan`` compares with every node.
    """
    least = threshold - _MARGIN
    own = np.full(len(queries), -1) if own is None else own
    base = len(graph.unit) if scan else _audited_width(graph, queries, least) if len(queries) else SEARCH_BEAM
    for start in range(0, len(queries), _BLOCK):
        open_rows, width = np.arange(start, min(len(queries), start + _BLOCK)), base
        while len(open_rows):
            # A beam to be widened gives way to the whole shard as soon as that is the lesser work.
            if 4 * width >= len(graph.unit) or (width > base and _SCAN * width >= len(graph.unit)):
                for rows in _in_parts(open_rows, len(graph.unit)):
                    a, k = np.nonzero(queries[rows] @ graph.unit.T >= least)
                    yield rows[a], k
                break
            still = []
            for rows in _in_parts(open_rows, width, _BEAMS):
                ids, sims = search_graph(graph, queries[rows], width)
                full = (sims >= least).sum(1) >= min(width, ids.shape[1]) * 3 // 4
                # A beam that does not meet the query itself has stalled elsewhere.
                full |= (own[rows] >= 0) & (ids != own[rows][:, None]).all(1)
                a, k = np.nonzero((sims >= least) & ~full[:, None])
                yield rows[a], ids[a, k]
                still.append(rows[full])
            open_rows, width = np.concatenate(still), 2 * width


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks()
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(array), -1)


def _to_size(vectors: np.ndarray) -> np.ndarray:
    """Vectors with a largest component between one half and one."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _in_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers, numbers of copies and vectors, by rising identifier."""
    ids = table.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], table.column("copies").to_numpy()[order], _matrix(table.column("embedding"))[order]


def _write_blocks(file: str, columns: dict[str, np.ndarray]) -> None:
    """Rows of arrays to a file of batches of ``QUERY_ROWS`` rows, each of which can be read alone."""
    folder, name = file.rsplit("/", 1)
    system, path = open_file_system(folder)
    system.create_dir(path, recursive=True)
    schema = pa.schema([(c, pa.binary(x[:1].nbytes)) for c, x in columns.items()])
    with system.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_file(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for k in range(0, len(next(iter(columns.values()))), QUERY_ROWS):
            parts = [np.ascontiguousarray(x[k : k + QUERY_ROWS]) for x in columns.values()]
            arrays = [pa.FixedSizeBinaryArray.from_buffers(f.type, len(x), [None, pa.py_buffer(x)]) for f, x in zip(schema, parts)]
            writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=schema))


def _read_blocks(file: str, block: int | None = None) -> Iterator[list[np.ndarray]]:
    """The bytes of every column, batch by batch, or those of one batch."""
    folder, name = file.rsplit("/", 1)
    system, path = open_file_system(folder)
    with system.open_input_file(f"{path}/{name}") as source, pa.ipc.open_file(source) as reader:
        for k in range(reader.num_record_batches) if block is None else [block]:
            batch = reader.get_batch(k)
            yield [np.frombuffer(x.buffers()[1], np.uint8, len(x) * x.type.byte_width, x.offset * x.type.byte_width).reshape(len(x), -1) for x in batch.columns]


_FILE_DDL = "dim int, shard int, file string, n long"


def _file_row(table: pa.Table, file: str) -> pa.Table:
    dim, shard = (table.column(c)[0].as_py() for c in ("dim", "shard"))
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "file": [file], "n": pa.array([len(table)], pa.int64())})


def _write_vectors(folder: str):
    """A block of vectors to a file, named by the attempt that writes it, so that rows and files always belong together."""

    def run(table: pa.Table) -> pa.Table:
        row = _file_row(table, f"{folder}/{TaskContext.get().taskAttemptId()}-{table.column('dim')[0].as_py()}-{table.column('shard')[0].as_py()}")
        ids, copies, vectors = _in_order(table)
        _write_blocks(f"{row.column('file')[0].as_py()}-vectors", {"ids": ids, "copies": copies, "vectors": vectors})
        return row

    return run


def _build(folder: str):
    """A shard to a file of its vectors and one of the levels of its graph."""
    write = _write_vectors(folder)

    def run(table: pa.Table) -> pa.Table:
        row = write(table)
        file = row.column("file")[0].as_py()
        unit = np.concatenate([_unit(block[2].view(np.float64)) for block in _read_blocks(f"{file}-vectors")])
        graph = build_graph(unit)
        _write_blocks(f"{file}-links", {f"level {k}": x for k, x in enumerate(graph.levels)} | {"entry": np.full(len(unit), graph.entry)})
        return row

    return run


_FOUND = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("links", pa.int64()), ("sign", pa.int64())])
_FOUND_DDL = "src long, dst long, links long, sign long"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A hash of every vector with its id, which ids of several vectors need."""
    bits = np.ascontiguousarray(vectors).view(np.uint64)
    return _mixed(_mixed(ids.astype(np.int64).view(np.uint64)) + _mixed(bits + np.arange(bits.shape[1], dtype=np.uint64)).sum(1))


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    at = order[np.minimum(np.searchsorted(keys[order], wanted), len(keys) - 1)]
    return np.where(keys[at] == wanted, at, -1)


def _least_ids(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the pairs and the least node each is tied to by them."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    labels = np.arange(len(nodes))
    while True:
        least = np.minimum(labels[x], labels[y])
        new = labels.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == labels).all():
            return nodes, nodes[labels]
        labels = new


class _Vectors(NamedTuple):
    """Vectors of a file, made ready for the search block by block."""

    ids: np.ndarray
    copies: np.ndarray
    keys: np.ndarray
    unit: np.ndarray
    vectors: np.ndarray  # brought to size by powers of two, which loses nothing, so that products neither overflow nor vanish
    norms: np.ndarray

    @classmethod
    def read(cls, file: str, n: int, block: int | None = None) -> _Vectors:
        whole, at = None, 0
        for ids, copies, vectors in _read_blocks(f"{file}-vectors", block):
            ids, copies, vectors = ids.view(np.int64)[:, 0], copies.view(np.int64)[:, 0], vectors.view(np.float64)
            sized = _to_size(vectors)
            part = cls(ids, copies, _keys(ids, vectors), _unit(vectors), sized, np.linalg.norm(sized, axis=1))
            if block is not None:
                return part
            whole = whole or cls(*(np.empty((n, *x.shape[1:]), x.dtype) for x in part))
            for all_of, x in zip(whole, part):
                all_of[at : at + len(x)] = x
            at += len(ids)
        return whole


def _read_graph(file: str, vectors: _Vectors) -> Graph:
    levels, at, entry = [], 0, 0
    for *links, start in _read_blocks(f"{file}-links"):
        links = [x.view(np.int32) for x in links]
        levels = levels or [np.empty((len(vectors.ids), x.shape[1]), np.int32) for x in links]
        for level, x in zip(levels, links):
            level[at : at + len(x)] = x
        at, entry = at + len(links[0]), int(start.view(np.int64)[0, 0])
    return Graph(vectors.unit, levels, entry)


def _search(shards: list[tuple[str, int]], blocks: list[tuple[str, int]], starts: list[int], offsets: list[int], threshold: float, scan: bool):
    """Links between the vectors of a shard and a block of queries; a task is the number of such a pair.

    The pairs of shard ``k`` and the blocks from ``offsets[k]`` on have the numbers from
    ``starts[k]`` on, so that following numbers share a graph.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, graph = -1, None, None
        for task in (n for batch in batches for n in batch.column(0).to_pylist()):
            k = bisect_right(starts, task) - 1
            if k != held:
                held, shard, graph = k, None, None  # before the next is read
                shard = _Vectors.read(*shards[k])
                graph = _read_graph(shards[k][0], shard)
            file, block = blocks[offsets[k] + task - starts[k]]
            yield _links(shard, graph, _Vectors.read(file, 0, block), threshold, scan)

    return run


def _links(shard: _Vectors, graph: Graph, asked: _Vectors, threshold: float, scan: bool) -> pa.RecordBatch:
    links = np.zeros(len(asked.ids), np.int64)
    # The exclusive or of the pairs of a node, once as query and once as found: nothing is left if both are the same.
    asked_sign, met_sign = np.zeros(len(asked.ids), np.uint64), np.zeros(len(shard.ids), np.uint64)
    tied: list[tuple[np.ndarray, np.ndarray]] = []
    for a, k in linked_pairs(graph, asked.unit, threshold, _places(shard.keys, asked.keys), scan):
        keep = np.zeros(len(a), bool)
        for s in range(0, len(a), QUERY_ROWS):
            p, q = a[s : s + QUERY_ROWS], k[s : s + QUERY_ROWS]
            keep[s : s + QUERY_ROWS] = np.einsum("nd,nd->n", asked.vectors[p], shard.vectors[q]) / (asked.norms[p] * shard.norms[q]) >= threshold
        keep &= asked.ids[a] != shard.ids[k]
        a, k = a[keep], k[keep]
        np.add.at(links, a, shard.copies[k])
        signs = _mixed(_mixed(np.minimum(asked.keys[a], shard.keys[k])) + np.maximum(asked.keys[a], shard.keys[k]))
        np.bitwise_xor.at(asked_sign, a, signs)
        np.bitwise_xor.at(met_sign, k, signs)
        if len(a):
            # Pairs of a block become stars at once, so groups never pile up as pairs.
            tied.append(_least_ids(asked.ids[a], shard.ids[k]))
    hit = np.flatnonzero(links)
    met = np.flatnonzero(met_sign)
    src, dst = [asked.ids[hit], shard.ids[met]], [asked.ids[hit], shard.ids[met]]
    n, sign = [links[hit], np.zeros(len(met), np.int64)], [asked_sign[hit].view(np.int64), met_sign[met].view(np.int64)]
    if tied:
        nodes, least = _least_ids(*(np.concatenate([t[i] for t in tied]) for i in range(2)))
        moved = nodes != least
        src.append(nodes[moved])
        dst.append(least[moved])
        n.append(np.zeros(int(moved.sum()), np.int64))
        sign.append(n[-1])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst, n, sign)], schema=_FOUND)


def settle_links(found: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``rep, links`` and ``rep, component`` of what was ``found``, every link counted at both ends.

    Components with a link found from one end alone are searched again by ``scan(reps)``, and so
    is what they turn out to be linked with; counts of a scan take the place of those before.
    """
    links = found.groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("links"), F.expr("bit_xor(sign)").alias("sign"))
    links = cut_lineage(links)
    bad, exact = links.where("sign <> 0").select("rep"), None
    ties = found.where("src <> dst").select("src", "dst")
    while True:
        joined = connected_components(ties).select(F.col("node").alias("rep"), F.col("group_id").alias("component"))
        joined = cut_lineage(joined)
        groups = joined.join(bad, "rep").select("component").distinct()
        todo = skew.lookup(joined, groups, "component", "rep").select("rep")
        if exact is not None:
            todo = todo.join(exact, "rep", "left_anti")
        todo = cut_lineage(todo)
        if todo.isEmpty():
            break
        more = scan(todo)
        sums = more.groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("links"))
        counted = todo.join(sums, "rep", "left").select("rep", F.coalesce("links", F.lit(0)).alias("links"))
        exact = cut_lineage(counted if exact is None else exact.unionByName(counted))
        bad = exact.select("rep")
        ties = ties.unionByName(more.where("src <> dst").select("src", "dst"))
    links = links.select("rep", "links")
    if exact is not None:
        links = links.join(exact, "rep", "left_anti").unionByName(exact)
    return links, joined


def near_duplicates(rows: DataFrame, threshold: float = COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``rows (vec_id, embedding)``.

    Vectors of cosine ``threshold`` or more are linked; equal vectors are searched once and
    counted with all their copies. Vectors that are NULL, empty, zero, or hold NULL or
    non-finite components, and vectors of different lengths, link with nothing. Rows of one
    ``vec_id`` count as one node of the links; a NULL ``vec_id`` is linked with nothing and
    has no component; an empty table gives no row; other columns are ignored.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    every = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    good = every.where(valid & F.col("vec_id").isNotNull())
    reps = good.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    reps = stored(reps.withColumn("dim", F.size("embedding")), "vectors")

    counts = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().collect()}
    shards = F.lit(1)
    for dim, count in counts.items():
        shards = F.when(F.col("dim") == dim, max(1, -(-count // shard_rows))).otherwise(shards)
    placed = reps.withColumn("shards", shards).withColumn("shard", F.pmod(F.xxhash64("embedding"), F.col("shards")).cast("int"))
    folder = shared_folder(rows.sparkSession, "graphs")
    dealt = placed.select("dim", "shard", "vec_id", "copies", "embedding")
    built = stored(dealt.groupBy("dim", "shard").applyInArrow(_build(folder), _FILE_DDL), "shards")
    shards = sorted(tuple(r) for r in built.collect())

    def search(asked: list[tuple], name: str, scan: bool) -> DataFrame:
        """What the vectors of the files ``asked`` find in all shards of their length."""
        spans, blocks = {}, []
        for dim, _, file, n in sorted(asked):
            start, _ = spans.get(dim, (len(blocks), 0))
            blocks += [(file, k) for k in range(-(-n // QUERY_ROWS))]
            spans[dim] = (start, len(blocks) - start)
        mine = [(file, n, *spans[dim]) for dim, _, file, n in shards if dim in spans]
        *starts, tasks = accumulate([0, *(x[3] for x in mine)])
        pairs = _search([x[:2] for x in mine], blocks, starts, [x[2] for x in mine], threshold, scan)
        numbers = rows.sparkSession.range(0, tasks, 1, max(1, min(tasks, MAX_TASKS)))
        # Written, not checkpointed: a checkpoint computes its rows twice.
        return stored(numbers.mapInArrow(pairs, _FOUND_DDL), name)

    def scan(todo: DataFrame) -> DataFrame:
        parts = F.lit(max(1, -(-todo.count() // QUERY_ROWS)))
        again = dealt.join(todo, dealt.vec_id == todo.rep, "left_semi").withColumn("shard", F.pmod(F.xxhash64(F.lit("scan"), "vec_id"), parts).cast("int"))
        files = stored(again.groupBy("dim", "shard").applyInArrow(_write_vectors(folder), _FILE_DDL), "queries")
        return search([tuple(r) for r in files.collect()], "scanned", True)

    links, joined = settle_links(search(shards, "found", False), scan)
    facts = reps.select("embedding", F.col("vec_id").alias("rep"), "copies")
    facts = facts.join(links, "rep", "left").join(joined, "rep", "left")
    facts = facts.select(
        F.col("embedding").alias("e"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n"),
        F.coalesce("component", "rep").alias("component"),
    )
    out = good.join(facts, F.col("embedding") == F.col("e")).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    alone = every.where(~valid | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
