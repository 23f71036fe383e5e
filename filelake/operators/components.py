"""Connected components of an edge table.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014) on DataFrames: the number of rounds grows with the logarithm
of the graph, not with the length of its longest chain. Nodes of one neighbour are put aside
first, so stars, which most groups of copies are, need no round at all. Every step needs only the
smallest neighbour of a node, which is pre-aggregated and handed out per slice, so a hub
that holds a third of all edges is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelake.operators.skew import lookup, with_group_stats
from filelake.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hood = with_group_stats(both, "u", "v", minimum={"m": F.col("v")})
    return hood.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the greater node ``u`` to the smaller ``v``."""
    hood = with_group_stats(edges, "u", "v", minimum={"m": F.col("v")})
    # (u, m) itself is the hood row with v = m; the other neighbours are linked to m.
    moved = F.when(F.col("v") == F.col("m"), F.struct("u", F.col("m").alias("v"))).otherwise(
        F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return hood.select(moved.alias("e")).select("e.u", "e.v")


def _is_done(edges: DataFrame) -> bool:
    """Whether every node either points at one node or is only pointed at."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"))
    )
    counts = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return counts.where("out > 1 or (out = 1 and least = 0)").isEmpty()


def _stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    """Turn distinct edges ``(u, v)``, ``u > v``, into one star per component around its least node."""
    for _ in range(max_rounds):
        if _is_done(edges):
            return edges
        edges = cut_lineage(_small_star(_large_star(edges)).distinct())
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")


def _peeled(edges: DataFrame) -> DataFrame:
    """Distinct edges ``(u, v)`` of ``u > v``, and whether either end is a leaf, a node of one neighbour.

    An aggregation over the neighbours tells the leaves, so a hub's edges are never joined.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hood = both.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"))
    leaves = hood.where("least = most").select(
        F.greatest("u", "least").alias("u"), F.least("u", "least").alias("v"), (F.col("u") > F.col("least")).alias("upper")
    )
    marks = edges.select("u", "v", F.lit(False).alias("u_leaf"), F.lit(False).alias("v_leaf")).unionByName(
        leaves.select("u", "v", F.col("upper").alias("u_leaf"), (~F.col("upper")).alias("v_leaf"))
    )
    return marks.groupBy("u", "v").agg(F.max("u_leaf").alias("u_leaf"), F.max("v_leaf").alias("v_leaf"))


def _labels(edges: DataFrame, max_rounds: int) -> DataFrame:
    """``(id, label)`` of every node but the centres, which are their own label.

    Only edges between nodes of several neighbours go through the rounds. A leaf takes the label of
    its neighbour; of two nodes that have only each other, the lesser is the centre.
    """
    marked = cut_lineage(_peeled(edges))
    hanging = marked.where("u_leaf or v_leaf").select(
        F.when(F.col("u_leaf"), F.col("u")).otherwise(F.col("v")).alias("id"),
        F.when(F.col("u_leaf"), F.col("v")).otherwise(F.col("u")).alias("stem"),
    )
    core = marked.where("not u_leaf and not v_leaf").select("u", "v")
    if core.isEmpty():
        return hanging.withColumnRenamed("stem", "label")
    stars = _stars(core, max_rounds).select(F.col("u").alias("id"), F.col("v").alias("label"))
    centres = stars.select(F.col("id").alias("stem"), "label")
    hung = lookup(hanging, centres, "stem", "id", how="left").select("id", F.coalesce("label", "stem").alias("label"))
    return stars.unionByName(hung)


def _ids(nodes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with a number each, and the pairs as numbers: hashes, unless two nodes have the same one."""
    hashed = cut_lineage(nodes.withColumn("id", _hash(F.col("node"))))
    if hashed.groupBy("id").count().where("count > 1").isEmpty():
        return hashed, pairs.select(_hash(F.col("src")).alias("a"), _hash(F.col("dst")).alias("b"))
    numbered = cut_lineage(hashed.select("node", F.monotonically_increasing_id().alias("id")))
    half = lookup(pairs, numbered.select(F.col("node").alias("src"), F.col("id").alias("a")), "src", "dst")
    return numbered, lookup(half, numbered.select(F.col("node").alias("dst"), F.col("id").alias("b")), "dst", "src")


def _hash(node: Column) -> Column:
    return F.xxhash64(node)


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(group_id, node, group_size)`` for every node of an edge ``(src, dst)`` between two nodes.

    The group id is the least node of the group. The rounds run on numbers given to the
    nodes, which are far shorter than paths.
    """
    pairs = cut_lineage(edges.where("src <> dst").select("src", "dst"))
    nodes, numbered = _ids(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), pairs)
    labels = _labels(numbered.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), max_rounds)
    named = nodes.join(labels, "id", "left").select("node", F.coalesce("label", "id").alias("label"))
    groups = with_group_stats(named, "label", "node", count="group_size", minimum={"group_id": F.col("node")})
    return groups.select("group_id", "node", "group_size")
