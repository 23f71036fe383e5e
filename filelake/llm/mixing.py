"""Mixing sources to target weights by pivotal dependent rounding, on DataFrame functions alone.

Every source gets a target in words, and a document of it the fractional number of copies
target / size of the source. Whole copies are certain; the fractions are rounded together:
two documents of a source exchange words at random until one of the two fractions is 0 or
1, which settles that document, and the other goes on. The words of the pair stay the same
in every exchange, so a source's total misses its target by less than one document. The
exchanges run in blocks of a few dozen documents, and the one open document of each block
goes to the next level of a tree of blocks; a source of any size, also one that holds most
rows, is spread over as many blocks as it needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filelake.llm.common import let
from filelake.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 48
_UNIT = 1 << 30
_ITEM = "struct<r:bigint,doc_id:bigint,h:bigint,size:bigint,p:double>"
_DONE = "array<struct<doc_id:bigint,h:bigint,size:bigint,k:double>>"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """``sizes (source, source_size)`` with ``target``: the common total dealt by weight, capped at ``cap`` sizes.

    Sources in order of code points, NULL last, take the weights in turn. Words above a cap
    are dealt again by weight to the sources below theirs until none is above: that ends at
    one number of words per weight for all uncapped sources, found by one pass over the
    sources in the order in which they reach their caps. There is one row per source here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    rows = sizes.withColumn("w", w).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    rows = rows.withColumn("reach", F.col("full") / F.col("w"))
    filling = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    open_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("turn", F.row_number().over(filling)).withColumn("level", left / open_weight)
    stop = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("turn", "level"))).over(everything)
    rows = rows.withColumn("stop", stop)
    share = F.when(F.col("turn") >= F.col("stop.turn"), F.least(F.col("stop.level") * F.col("w"), F.col("full")))
    return rows.select("source", "source_size", F.coalesce(share, "full").alias("target"))


def _uniform(*seeds: Column) -> Column:
    return (F.pmod(F.xxhash64(*seeds), F.lit(_UNIT)) + F.lit(0.5)) / F.lit(float(_UNIT))


def _meet(state: Column, x: Column, seed: int) -> Column:
    """One exchange of words between the open item of ``state`` and ``x``."""
    c = state["c"]
    a, b, wa, wb = c["p"], x["p"], c["size"].cast("double"), x["size"].cast("double")
    facts = F.struct(
        F.least((1 - a) * wa, b * wb).alias("up"),
        F.least(a * wa, (1 - b) * wb).alias("down"),
        _uniform(F.lit(seed), c["r"], x["r"]).alias("u"),
    )

    def after(f: Column) -> Column:
        rises = f["u"] * (f["up"] + f["down"]) < f["down"]
        filled, emptied = f["up"] == (1 - a) * wa, f["down"] == a * wa
        na = F.when(rises, F.when(filled, 1.0).otherwise(a + f["up"] / wa)).otherwise(F.when(emptied, 0.0).otherwise(a - f["down"] / wa))
        nb = F.when(rises, F.when(filled, b - f["up"] / wb).otherwise(0.0)).otherwise(F.when(emptied, b + f["down"] / wb).otherwise(1.0))
        return F.struct(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), na)).alias("a"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), nb)).alias("b"),
            F.when(rises, filled).otherwise(emptied).alias("c_ends"),
        )

    def settle(t: Column) -> Column:
        def item(y: Column, p: Column) -> Column:
            return F.struct(y["r"].alias("r"), y["doc_id"].alias("doc_id"), y["h"].alias("h"), y["size"].alias("size"), p.alias("p"))

        def done(y: Column, k: Column) -> Column:
            return F.struct(y["doc_id"].alias("doc_id"), y["h"].alias("h"), y["size"].alias("size"), k.alias("k"))

        return F.struct(
            F.when(t["c_ends"], item(x, t["b"])).otherwise(item(c, t["a"])).cast(_ITEM).alias("c"),
            F.concat(state["done"], F.array(F.when(t["c_ends"], done(c, t["a"])).otherwise(done(x, t["b"])))).cast(_DONE).alias("done"),
        )

    return let(let(facts, after), settle)


def _round_blocks(pool: DataFrame, seed: int) -> DataFrame:
    """Per block of ``pool (source, block, item)``: its one open item and the settled ones."""
    items = F.array_sort(F.collect_list("item"))
    blocks = pool.groupBy("source", "block").agg(items.alias("items"))
    start = F.struct(F.col("items")[0].cast(_ITEM).alias("c"), F.array().cast(_DONE).alias("done"))
    rest = F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0)))
    return blocks.select("source", F.aggregate(rest, start, lambda s, x: _meet(s, x, seed)).alias("s"))


def pivotal_copies(items: DataFrame, largest: int, seed: int = 0) -> DataFrame:
    """Round the fractions of ``items (source, doc_id, h, r, size, p)``; gives ``source, doc_id, h, size, k``, k 0 or 1.

    ``r`` orders the items of a source at random and is the same in every run; ``largest``
    bounds the items of a source.
    """
    settled, level = [], 0
    pool = items.select("source", F.struct("r", "doc_id", "h", "size", "p").cast(_ITEM).alias("item"))
    width = max(1, -(-largest // BLOCK))
    while True:
        # Blocks are dealt by the hash of the random order, so they are alike in size.
        block = F.pmod(F.xxhash64(F.lit(seed + level), "item.r"), F.lit(width)).cast("int")
        folded = cut_lineage(_round_blocks(pool.withColumn("block", block), seed + level))
        settled.append(folded.select("source", F.explode("s.done").alias("d")).select("source", "d.doc_id", "d.h", "d.size", "d.k"))
        pool = folded.select("source", F.col("s.c").alias("item"))
        if width == 1:
            break
        width, level = max(1, -(-width // BLOCK)), level + 1
    last = (_uniform(F.lit(seed), F.lit("last"), F.col("item.r")) < F.col("item.p")).cast("double")
    settled.append(pool.select("source", "item.doc_id", "item.h", "item.size", last.alias("k")))
    return reduce(DataFrame.unionByName, settled)


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """Copies of every document so that each source's words come near its target.

    Reads ``doc_id, text, source``; other columns are ignored. Returns one row per row:
    ``doc_id, source, h, size, source_size, target, copies, taken``, with ``h`` a hash of the
    text. A NULL or empty text has
    size 0 and takes nothing; NULL is a source of its own; repeated rows are rounded one by
    one; an empty table gives no row. The same rows give the same copies in every run.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("h"))
    # Rows alike in all that matters here are counted once, so that repeats never meet in one place.
    rows = cut_lineage(rows.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("m")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n"))
    sizes = cut_lineage(sizes)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = source_targets(sizes.select("source", "source_size"), weights, cap).withColumn("x", F.round(copies, 12))
    targets = cut_lineage(targets.withColumn("whole", F.floor("x")).withColumn("p", F.col("x") - F.floor("x")))
    named = targets.withColumnRenamed("source", "s")

    largest = sizes.agg(F.max("n")).first()[0] or 0
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    each = each.join(named.select("s", "p"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    each = each.withColumn("r", F.xxhash64(F.lit(seed), "doc_id", "h", "i"))
    is_open = (F.col("p") > 0) & (F.col("size") > 0)
    rounded = pivotal_copies(each.where(is_open), largest, seed)
    fixed = each.where(~is_open).select("source", "doc_id", "h", "size", F.lit(0.0).alias("k"))
    taken = rounded.unionByName(fixed).join(named, F.col("source").eqNullSafe(F.col("s")))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("k").cast("long")).otherwise(0).cast("long")
    return taken.select(
        "doc_id", "source", "h", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def take_mixture(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it, which may be never.

    Rows alike in id, source and text share their copies: every one of them appears with the
    mean of what they were given, rounded down, and the rest goes to the first of them.
    """
    # Names that no input column has.
    own_name = f"mix_{uuid.uuid4().hex}_".__add__
    doc_id, source, h, given_copies, text, n, turn, copy = map(own_name, ("doc_id", "source", "h", "copies", "text", "n", "turn", "copy"))
    given = mix_sources(docs, weights, cap, seed).where("copies > 0").groupBy("doc_id", "source", "h").agg(F.sum("copies").cast("int").alias("copies"))
    given = given.select(F.col("doc_id").alias(doc_id), F.col("source").alias(source), F.col("h").alias(h), F.col("copies").alias(given_copies))
    alike = docs.withColumn(text, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col(doc_id)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(text) == F.col(h))
    group = Window.partitionBy("doc_id", "source", text)
    shared = alike.join(given, same).withColumn(n, F.count(F.lit(1)).over(group))
    shared = shared.withColumn(turn, F.row_number().over(group.orderBy(F.lit(0))))
    own = F.floor(F.col(given_copies) / F.col(n)) + F.when(F.col(turn) == 1, F.col(given_copies) % F.col(n)).otherwise(0)
    dealt = shared.withColumn(copy, F.explode(F.sequence(F.lit(0), own.cast("int")))).where(F.col(copy) > 0)
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns])
