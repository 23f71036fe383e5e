"""Hard negatives by inner product, mined with STR-packed R-trees.

Sort-tile-recursive packing (Leutenegger, Lopez and Edgington) sorts points by one coordinate,
cuts them into slabs, and goes on with the next coordinate within each slab until a slab fills
one leaf. A box ``[low, high]`` bounds the inner product with an anchor ``a`` coordinate by
coordinate: ``a_i x_i`` lies between ``a_i low_i`` and ``a_i high_i``. Boxes wait in a queue by
their upper bounds; a box is left out if it lies outside the score window or strictly below
the k-th score found, so that ties are still met.

Over many machines the first two tilings are done by Spark, with quantiles of the two widest
coordinates; each tile is a *shard* with one tree per label (a tile with too many rows, such
as copies of one vector, becomes several shards). An anchor asks its own shard first. The k-th
scores found there and the boxes of all shards say which other shards it has to ask.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filelake.llm.common import stored
from filelake.llm.counts import pack, unpack

SHARD_ROWS = 8192
LEAF = 64
FANOUT = 16
# Anchors in one search task, and anchors and roots that meet in one routing task.
ASKED_ROWS = 4096
_EXACT = float(1 << 53)


def str_order(points: np.ndarray, rows: np.ndarray, axes: Sequence[int], leaf: int) -> list[np.ndarray]:
    """Row numbers of the leaves, sort-tile-recursive over ``axes``."""
    pages = -(-len(rows) // leaf)
    if pages <= 1:
        return [rows]
    slabs = int(np.ceil(pages ** (1 / len(axes)))) if len(axes) > 1 else pages
    rows = rows[np.argsort(points[rows, axes[0]], kind="stable")]
    step = leaf * -(-pages // slabs)
    parts = [rows[i : i + step] for i in range(0, len(rows), step)]
    if len(axes) == 1:
        return parts
    return [leaf_rows for part in parts for leaf_rows in str_order(points, part, axes[1:], leaf)]


class Forest:
    """R-trees of one shard, one per label, in flat arrays; the leaves come first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, nodes: np.ndarray, roots: np.ndarray):
        self.ids, self.labels, self.points = ids, labels, points
        self.low, self.high = low, high
        # Of a node: first child (a row for leaves), how many, whether it is a leaf.
        self.nodes, self.roots = nodes, roots

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> Forest:
        order, spans, roots = [], [], []
        axes = np.argsort(-points.std(axis=0), kind="stable")
        low, high, at = [], [], 0
        inner: list[tuple[list[int], int]] = []
        for label in np.unique(labels):
            leaves = str_order(points, np.flatnonzero(labels == label), axes, leaf)
            level = []
            for rows in leaves:
                level.append(len(spans))
                spans.append((at, len(rows)))
                at += len(rows)
                order.append(rows)
                low.append(points[rows].min(axis=0))
                high.append(points[rows].max(axis=0))
            inner.append((level, int(label)))
        nodes = [(first, many, 1) for first, many in spans]
        for level, _ in inner:
            while len(level) > 1:
                above = []
                for i in range(0, len(level), fanout):
                    members = level[i : i + fanout]
                    above.append(len(nodes))
                    nodes.append((members[0], len(members), 0))
                    low.append(np.min([low[m] for m in members], axis=0))
                    high.append(np.max([high[m] for m in members], axis=0))
                level = above
            roots.append(level[0])
        rows = np.concatenate(order)
        return cls(ids[rows], labels[rows], points[rows], np.array(low), np.array(high), np.array(nodes, np.int64), np.array(roots, np.int64))

    def root_label(self) -> np.ndarray:
        first = self.roots.copy()
        while not self.nodes[first, 2].all():
            first = np.where(self.nodes[first, 2] == 1, first, self.nodes[first, 0])
        return self.labels[self.nodes[first, 0]]

    def to_bytes(self) -> bytes:
        parts = (self.ids, self.labels, self.points.ravel(), self.low.ravel(), self.high.ravel(), self.nodes.ravel(), self.roots)
        return pack(*(np.ascontiguousarray(p) for p in parts))

    @classmethod
    def from_bytes(cls, data: bytes) -> Forest:
        ids, labels, points, low, high, nodes, roots = unpack(data)
        wide = len(points) // len(ids)
        return cls(ids, labels, points.reshape(-1, wide), low.reshape(-1, wide), high.reshape(-1, wide), nodes.reshape(-1, 3), roots)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with the points of each box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as floats where all products and sums are exact, else as Python's own."""
    most = [float(np.abs(a).max()) if a.size else 0.0 for a in arrays]
    if arrays[0].shape[1] * max(most[0], 1.0) * max(most[1:], default=0.0) < _EXACT:
        return list(arrays)
    whole = np.frompyfunc(int, 1, 1)
    return [whole(a).astype(object) for a in arrays]


class ScoreWindow:
    """A score window of one anchor and the best rows in it so far."""

    __slots__ = ("tag", "least", "most", "k", "best", "floor")

    def __init__(self, tag: int, least: float | None, most: float | None, floor: float | None, k: int):
        # The k-th score known from elsewhere counts as well: rows strictly below it are not sought.
        known = [x for x in (least, floor) if x is not None]
        self.tag, self.k, self.best = tag, k, []
        self.least, self.most = max(known) if known else None, most
        self.floor = self.least

    def wants(self, least, most) -> bool:
        return (self.floor is None or most >= self.floor) and (self.most is None or least <= self.most)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        inside = np.ones(len(ids), bool)
        if self.floor is not None:
            inside &= (scores >= self.floor).astype(bool)
        if self.most is not None:
            inside &= (scores <= self.most).astype(bool)
        if not inside.any():
            return
        found = [(-int(s), int(i)) for s, i in zip(scores[inside], ids[inside])]
        self.best = sorted(self.best + found)[: self.k]
        if len(self.best) == self.k:
            self.floor = -self.best[-1][0] if self.least is None else max(self.least, -self.best[-1][0])


def search(forest: Forest, anchor_id: int, anchor: np.ndarray, label: int, same: bool, windows: list[ScoreWindow]) -> None:
    """Best-first search of the trees of the anchor's own label, or of all others; fills the windows."""
    chosen = forest.roots[(forest.root_label() == label) == same]
    if not len(chosen):
        return
    vector, points, low, high = _exact(anchor[None, :], forest.points, forest.low, forest.high)
    least, most = (b[0] for b in bounds(vector, low, high))
    queue = [(-most[r], int(r)) for r in chosen]
    heapq.heapify(queue)
    while queue:
        upper, node = heapq.heappop(queue)
        if all(w.floor is not None and -upper < w.floor for w in windows):
            return
        if not any(w.wants(least[node], most[node]) for w in windows):
            continue
        first, many, leaf = forest.nodes[node].tolist()
        if leaf:
            ids = forest.ids[first : first + many]
            scores = points[first : first + many] @ vector[0]
            other = ids != anchor_id
            for w in windows:
                w.add(ids[other], scores[other])
        else:
            for child in range(first, first + many):
                if any(w.wants(least[child], most[child]) for w in windows):
                    heapq.heappush(queue, (-most[child], child))


def _build(table: pa.Table) -> pa.Table:
    ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
    points = np.array(table.column("vec").to_pylist(), float)
    # Rows arrive in any order: the same rows make the same trees.
    sort = np.argsort(ids)
    forest = Forest.build(ids[sort], labels[sort], points[sort])
    body = forest.to_bytes()
    roots = pack(forest.root_label(), np.ascontiguousarray(forest.low[forest.roots]).ravel(), np.ascontiguousarray(forest.high[forest.roots]).ravel())
    names = ["dim", "shard", "n_roots", "roots", "body"]
    return pa.table([[points.shape[1]], [table.column("shard")[0].as_py()], [len(forest.roots)], [roots], [body]], names=names).cast(_TREES)


_TREES = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("n_roots", pa.int64()), ("roots", pa.binary()), ("body", pa.binary())])
_TREES_DDL = "dim int, shard long, n_roots long, roots binary, body binary"
_HITS = pa.schema([("anchor_id", pa.int64()), ("tag", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_HITS_DDL = "anchor_id long, tag long, vec_id long, score long"


def _vectors(table: pa.Table) -> np.ndarray:
    return np.array(table.column("vec").to_pylist(), float)


def _search_task(same: bool, k: int):
    def task(trees: pa.Table, asked: pa.Table) -> pa.Table:
        hits: list[tuple] = []
        if trees.num_rows and asked.num_rows:
            forest = Forest.from_bytes(trees.column("body")[0].as_py())
            columns = (asked.column(c).to_pylist() for c in ("anchor_id", "label", "windows"))
            for vector, ident, label, windows in zip(_vectors(asked), *columns):
                open_ = [ScoreWindow(w["tag"], w["least"], w["most"], w["floor"], k) for w in windows]
                search(forest, ident, vector, label, same, open_)
                hits += [(ident, w.tag, i, -s) for w in open_ for s, i in w.best]
        return pa.table([pa.array([h[c] for h in hits], t.type) for c, t in enumerate(_HITS)], schema=_HITS)

    return task


def _route_task(same: bool):
    def task(trees: pa.Table, asked: pa.Table) -> pa.Table:
        out_ids, out_shards = [], []
        if trees.num_rows and asked.num_rows:
            anchors = _vectors(asked)
            ids, labels, home = (asked.column(c).to_numpy() for c in ("anchor_id", "label", "home"))
            windows = asked.column("windows").to_pylist()
            # A window without a bound is open on that side.
            low_of = [[max((x for x in (w["least"], w["floor"]) if x is not None), default=-np.inf) for w in ws] for ws in windows]
            high_of = [[np.inf if w["most"] is None else w["most"] for w in ws] for ws in windows]
            for shard, body in zip(trees.column("shard").to_pylist(), trees.column("roots").to_pylist()):
                root_labels, low, high = unpack(body)
                a, low, high = _exact(anchors, low.reshape(len(root_labels), -1), high.reshape(len(root_labels), -1))
                least, most = bounds(a, low, high)
                usable = ((labels[:, None] == root_labels) == same) & (home != shard)[:, None]
                for k in np.flatnonzero(usable.any(axis=1)).tolist():
                    lo, hi = least[k][usable[k]], most[k][usable[k]]
                    if any(((hi >= x) & (lo <= y)).any() for x, y in zip(low_of[k], high_of[k])):
                        out_ids.append(ids[k])
                        out_shards.append(shard)
        return pa.table([pa.array(out_ids, pa.int64()), pa.array(out_shards, pa.int64())], names=["anchor_id", "shard"])

    return task


def _tiles(points: DataFrame, shard_rows: int) -> DataFrame:
    """``points`` with the shard of each row: tiles by quantiles of the two widest coordinates, large ones cut by hash."""
    sizes = {r["dim"]: r["count"] for r in points.groupBy("dim").count().collect()}
    spread = points.select("dim", F.posexplode("vec").alias("axis", "x")).groupBy("dim", "axis").agg(F.coalesce(F.var_pop("x"), F.lit(0.0)).alias("spread"))
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("spread"), "axis"))
    axes: dict[int, list[int]] = {}
    for r in spread.withColumn("place", place).where("place <= 2").orderBy("dim", "place").collect():
        axes.setdefault(r["dim"], []).append(r["axis"])

    def by_dim(value) -> Column:
        out = F.lit(None)
        for dim in sizes:
            out = F.when(F.col("dim") == dim, value(dim)).otherwise(out)
        return out

    slabs = {dim: int(np.ceil(np.sqrt(-(-n // shard_rows)))) for dim, n in sizes.items()}
    tiled = points.withColumn("x", by_dim(lambda d: F.col("vec")[axes[d][0]])).withColumn("y", by_dim(lambda d: F.col("vec")[axes[d][-1]]))

    def cut(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
        """Slab of each row by the quantiles of ``value`` within ``keys``; a row per group is joined."""
        grid = F.lit(None).cast("array<double>")
        for dim, n in slabs.items():
            steps = [i / n for i in range(1, n)] or [1.0]
            grid = F.when(F.col("dim") == dim, F.percentile_approx(value, steps, 10_000)).otherwise(grid)
        edges = df.groupBy(*keys).agg(grid.alias("edges"))
        return df.join(edges, keys).withColumn(name, F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges")

    tiled = cut(cut(tiled, ["dim"], "x", "slab"), ["dim", "slab"], "y", "tile")
    many = tiled.groupBy("dim", "slab", "tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).alias("parts"))
    tiled = tiled.join(many, ["dim", "slab", "tile"])
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    return tiled.select("dim", F.xxhash64("dim", "slab", "tile", part).alias("shard"), "vec_id", "label", "vec", "asks")


_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``rows (vec_id, label, vec)``.

    ``vec`` holds whole numbers; a score is the exact inner product. For every anchor (a row
    where ``is_anchor``) its first ``positives`` other rows of the same label are paired with
    the first ``negatives`` rows of other labels whose score lies between ``low`` and ``high``
    hundredths of the positive's. Higher scores are first, equal ones by lesser ``vec_id``.

    Rows with NULL ``vec_id``, ``label`` or ``vec``, an empty vector, or a component that is
    NULL or not finite take no part. Rows of one ``vec_id`` count once, as the least of them.
    Vectors of different lengths are not compared. An anchor without positives, and a positive
    without negatives (always so if its score is negative), gives no row; an empty table gives
    none. Scores must fit 64 bits, else the job ends with an error. Other columns are ignored.
    """
    spark = rows.sparkSession
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    typed = rows.select("vec_id", F.col("label").cast("long").alias("label"), F.col("vec").cast("array<double>").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    valid = typed.where("vec_id is not null and label is not null and size(vec) > 0").where(finite)
    one = valid.groupBy("vec_id").agg(F.min(F.struct("label", "vec", "asks")).alias("row")).select("vec_id", "row.*")
    points = stored(one.withColumn("dim", F.size("vec")), "points")
    n_anchors = points.where("asks").count()
    if not n_anchors:
        return spark.createDataFrame([], _MINED)
    # Quantiles are approximate and may differ from run to run, so tiles are written before they are used twice.
    placed = stored(_tiles(points, shard_rows), "placed")
    trees = stored(placed.select("dim", "shard", "vec_id", "label", "vec").groupBy("dim", "shard").applyInArrow(_build, _TREES_DDL), "trees")
    anchors = placed.where("asks").select("dim", F.col("vec_id").alias("anchor_id"), "label", "vec", F.col("shard").alias("home"))
    parts = F.lit(-(-n_anchors // ASKED_ROWS))
    n_roots = trees.agg(F.sum("n_roots")).first()[0]
    pages = F.lit(-(-n_roots // ASKED_ROWS))

    def ask(asked: DataFrame, same: bool, k: int) -> DataFrame:
        """Hits of requests ``anchor_id, dim, label, vec, windows, shard``."""
        dealt = asked.withColumn("part", F.pmod(F.xxhash64("anchor_id"), parts))
        used = dealt.select(F.col("shard").alias("tree"), F.col("part").alias("piece")).distinct()
        bodies = used.join(trees.select(F.col("shard").alias("tree"), "body"), "tree")
        return bodies.groupBy("tree", "piece").cogroup(dealt.groupBy("shard", "part")).applyInArrow(_search_task(same, k), _HITS_DDL)

    def first(hits: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def rounds(asked: DataFrame, same: bool, k: int) -> DataFrame:
        """The first ``k`` rows of every window: own shards first, then those that may hold better ones."""
        near = stored(first(ask(asked.withColumn("shard", F.col("home")), same, k), k), "near")
        floors = near.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.col("score")))).alias("floors"))
        bounded = asked.join(floors, "anchor_id", "left").withColumn("floors", F.coalesce("floors", F.create_map().cast("map<bigint,bigint>")))
        bounded = bounded.withColumn(
            "windows",
            F.transform("windows", lambda w: F.struct(w["tag"].alias("tag"), w["least"].alias("least"), w["most"].alias("most"), F.col("floors")[w["tag"]].alias("floor"))),
        ).drop("floors")
        met = bounded.withColumn("part", F.pmod(F.xxhash64("anchor_id"), parts)).withColumn("page", F.explode(F.sequence(F.lit(0), pages - 1)))
        shown = trees.select("dim", "shard", "roots").withColumn("page", F.pmod(F.xxhash64("shard"), pages).cast("int"))
        shown = shown.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))))
        keys = ["dim", "page", "part"]
        routes = shown.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(_route_task(same), "anchor_id long, shard long")
        far = ask(bounded.join(routes, "anchor_id"), same, k)
        return first(near.drop("rank").unionByName(far), k)

    def window(tag: Column, least: Column, most: Column) -> Column:
        return F.struct(tag.cast("long").alias("tag"), least.cast("long").alias("least"), most.cast("long").alias("most"), F.lit(None).cast("long").alias("floor"))

    every = anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(None), F.lit(None))))
    chosen = stored(rounds(every, True, positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Hundredths without rounding and overflow.
    least = F.expr(f"positive_score div 100 * {low} + (positive_score % 100 * {low} + 99) div 100")
    most = F.expr(f"positive_score div 100 * {high} + positive_score % 100 * {high} div 100")
    found = chosen.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(window(F.col("positive_id"), least, most)).alias("windows"))
    mined = rounds(anchors.join(found, "anchor_id"), False, negatives)
    mined = mined.withColumnRenamed("tag", "positive_id").join(chosen, ["anchor_id", "positive_id"])
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
