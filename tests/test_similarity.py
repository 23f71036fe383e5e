"""Similarity joins and grouping against brute force, with tiny blocks and hot groups."""

import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from filelake.operators import components, similarity
from filelake.operators.similarity import Hamming, band_pairs, band_scheme, metric_pairs, similar_documents, similar_images, similar_vectors
from filelake.operators.skew import lookup, with_group_stats
from filelake.plans import reports


def pairs_of(df):
    rows = [(r.src, r.dst) for r in df.select("src", "dst").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def hashes(spark):
    """Clusters of 64-bit hashes a few bits apart."""
    rng = np.random.default_rng(1)
    values = []
    for centre in rng.integers(0, 2**64, size=40, dtype=np.uint64):
        values.append(int(centre))
        for _ in range(10):
            x = int(centre)
            for bit in rng.choice(64, size=int(rng.integers(1, 12)), replace=False):
                x ^= 1 << int(bit)
            values.append(x)
    values = list(dict.fromkeys(values))
    df = spark.createDataFrame([(f"i{i:04d}", v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "path string, value long")
    array = np.array(values, dtype=np.uint64)
    return df.cache(), np.bitwise_count(array[:, None] ^ array[None, :])


@pytest.mark.parametrize("distance", [1, 4, 10])
def test_band_and_metric_pairs_equal_brute_force(hashes, distance):
    df, apart = hashes
    want = {(f"i{i:04d}", f"i{j:04d}") for i, j in zip(*np.nonzero(np.triu(apart <= distance, 1)))}
    assert pairs_of(metric_pairs(df, Hamming(distance), block_rows=16)) == want
    for scheme in [None, (distance + 1, 1), (distance + 2, 2)]:
        assert pairs_of(band_pairs(df, distance, scheme, block_rows=16)) == want


@pytest.mark.parametrize("distance, widths, radii", [(12, [16] * 4, [3, 2, 2, 2]), (18, [13, 13, 13, 13, 12], [3, 3, 3, 3, 2]), (11, [22, 21, 21], [3, 3, 3])])
def test_neighbour_pairs_equal_brute_force(hashes, distance, widths, radii):
    df, apart = hashes
    want = {(f"i{i:04d}", f"i{j:04d}") for i, j in zip(*np.nonzero(np.triu(apart <= distance, 1)))}
    scheme = similarity.Neighbours(widths, radii)
    assert sum(radii) == distance - len(radii) + 1 and scheme.keys() < 20_000
    few = df if scheme.keys() < 2_000 else df.where("path < 'i0060'")
    assert pairs_of(similarity.neighbour_pairs(few, distance, scheme)) == {p for p in want if few is df or p[1] < "i0060"}


def test_neighbours_are_chosen_when_they_pay():
    scheme, cost = similarity.neighbour_scheme(12, 10**9)
    assert scheme.radii == [4, 3, 3] and scheme.share(64) < 0.004 and cost < 1e9 / 2 / similarity.BLOCK_GAIN
    assert similarity.neighbour_scheme(18, 10**5)[1] > 1e5 / 2 / similarity.BLOCK_GAIN


def test_band_scheme_takes_longer_keys_for_more_rows():
    small, large = band_scheme(4, 1_000), band_scheme(4, 10**10)
    assert small[0] - small[1] == large[0] - large[1] == 4
    assert large[1] > small[1]


def test_bands_share_out_the_information():
    entropy = [0.0] * 24 + [1.0] * 40
    masks = similarity.band_masks(entropy, 5)
    assert sum(masks) == 2**64 - 1 and all(bin(m >> 24).count("1") == 8 for m in masks)
    assert band_scheme(4, 10**6, 40.0)[1] > 1


def test_band_pairs_with_constant_bits(spark):
    values = list(range(0, 4000, 7))
    df = spark.createDataFrame([(f"i{v:04d}", v) for v in values], "path string, value long")
    want = {(f"i{a:04d}", f"i{b:04d}") for a in values for b in values if a < b and bin(a ^ b).count("1") <= 2}
    assert pairs_of(band_pairs(df, 2, block_rows=32)) == want


@pytest.mark.parametrize("block_rows", [300, similarity.MAX_BLOCK_ROWS])
def test_large_band_keys_are_compared_by_blocks(spark, block_rows):
    """At 18 bits bands are short, so most pairs share a key: they must not become rows."""
    rng = np.random.default_rng(4)
    values = np.unique(np.concatenate([rng.integers(0, 2**64, 1500, dtype=np.uint64), rng.integers(0, 2**24, 1500, dtype=np.uint64)]))
    df = spark.createDataFrame([(f"i{i:04d}", int(v)) for i, v in enumerate(values.view(np.int64))], "path string, value long")
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    want = {(f"i{i:04d}", f"i{j:04d}"): int(apart[i, j]) for i, j in zip(*np.nonzero(np.triu(apart <= 18, 1)))}
    found = band_pairs(df, 18, block_rows=block_rows)
    assert "FlatMapGroupsInArrow" in plan_of(found)
    rows = found.collect()
    assert len(rows) == len(want) and {(r.src, r.dst): r.score for r in rows} == want


def test_band_join_is_an_equi_join(hashes):
    plan = plan_of(band_pairs(hashes[0], 4))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("threshold", [0.97, 0.5, -0.2])
def test_similar_vectors_equal_brute_force(spark, threshold):
    rng = np.random.default_rng(2)
    points = np.repeat(rng.normal(size=(20, 16)), 15, axis=0) + rng.normal(size=(300, 16)) * 0.15
    points = points.astype(np.float32)
    rows = [(f"p{i:04d}", [float(x) for x in v]) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "path string, embedding array<float>")
    unit = points.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {(f"p{i:04d}", f"p{j:04d}") for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= threshold, 1)))}
    assert pairs_of(similar_vectors(df, threshold, block_rows=16)) == want


def test_products_held_at_a_time_are_bounded(spark):
    limit = similarity.STRIP_PRODUCTS

    class Watched(similarity.Angular):
        def hits(self, a, b):
            assert len(a) * len(b) <= limit
            return super().hits(a, b)

    rows = spark.range(6000).select(F.col("id").cast("string").alias("path"), F.array(F.lit(1.0), F.col("id") * 1.0).alias("value"))
    assert metric_pairs(rows, Watched(0.999999999)).where("src = dst").count() == 0


def test_equal_vectors_form_a_star_and_zero_vectors_stay_alone(spark):
    rows = [(f"c{i:03d}", [1.0, 2.0]) for i in range(100)] + [("z1", [0.0, 0.0]), ("z2", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "path string, embedding array<float>")
    assert pairs_of(similar_vectors(df, 0.9)) == {("c000", f"c{i:03d}") for i in range(1, 100)}


def test_similar_images_defaults_and_copies(spark):
    rows = [("a", "00000000000000ff"), ("b", "00000000000000ff"), ("c", "00000000000000fe"), ("d", "ffff0000000000ff"), ("n", None)]
    df = spark.createDataFrame(rows, "path string, perceptual_hash string")
    assert pairs_of(similar_images(df)) == {("a", "b")}
    assert {(r.src, r.dst, r.distance) for r in similar_images(df, 4).collect()} == {("a", "b", 0), ("a", "c", 1)}
    groups = reports.image_similar_groups(df, 4).collect()
    assert {(r.group_id, r.path, r.group_size) for r in groups} == {("a", p, 3) for p in "abc"}
    assert reports.image_similar_groups(df.where("path = 'a'"), 4).count() == 0
    with pytest.raises(ValueError):
        similar_images(df, 65)


def test_hash_of_all_ones_is_read(spark):
    df = spark.createDataFrame([("a", "f" * 16), ("b", "7" + "f" * 15)], "path string, perceptual_hash string")
    assert [r.distance for r in similar_images(df, 1).collect()] == [1]


@pytest.mark.parametrize("threshold", [0.5, 0.9, 1.0])
def test_similar_documents_equal_brute_force(spark, threshold):
    rng = np.random.default_rng(3)
    common, rare = [f"w{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    texts = []
    for i in range(150):
        words = list(rng.choice(common, size=30)) + list(rng.choice(rare, size=10))
        texts += [" ".join(words), " ".join(words[:-1] + ["r1"]), " ".join(reversed(words)), " ".join(words * 2)][: 1 + i % 4]
    texts += ["", "  \n"]
    df = spark.createDataFrame([(f"d{i:04d}", t) for i, t in enumerate(texts)], "path string, text string")
    bags = [Counter(t.split()) for t in texts]
    norms = [math.sqrt(sum(n * n for n in b.values())) for b in bags]
    first, want = {}, set()
    for i, bag in enumerate(bags):
        if not bag:
            continue
        key = tuple(sorted(bag.items()))
        if key in first:
            want.add((f"d{first[key]:04d}", f"d{i:04d}"))
            continue
        for j in first.values():
            cosine = sum(n * bag[w] for w, n in bags[j].items()) / (norms[i] * norms[j])
            if cosine >= threshold - (1e-9 if threshold == 1.0 else 0):
                want.add((f"d{j:04d}", f"d{i:04d}"))
        first[key] = i
    got = pairs_of(similar_documents(df, threshold, block_rows=8))
    if threshold == 1.0:
        # Products of equal direction may round to just below one.
        assert got <= want
    else:
        assert got == want


def test_pairs_of_documents_need_no_shuffle(spark):
    # All texts are alike by one frequent word and lie in several blocks; some are copies.
    texts = [" ".join(["|"] * 20 + [f"a{i % 30}", f"b{i % 30}"]) for i in range(40)]
    df = spark.createDataFrame([(f"d{i:02d}", t) for i, t in enumerate(texts)], "path string, text string")
    found = similar_documents(df, 0.95, block_rows=4)
    assert "Exchange" not in plan_of(found)
    copies = {(f"d{i:02d}", f"d{i + 30:02d}") for i in range(10)}
    assert pairs_of(found) == copies | {(f"d{i:02d}", f"d{j:02d}") for j in range(30) for i in range(j)}


def term_group(texts, folder, monkeypatch, threshold=0.95):
    """Documents as one group, as a task reads it."""
    monkeypatch.setattr(similarity, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(taskAttemptId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"path": [f"d{i:04d}" for i in range(len(texts))], "text": texts})
    rows = pa.Table.from_batches(similarity._bags(folder, len(texts))([batch])).to_pylist()
    heaviest = np.array([h for _, h in sorted(zip(rows[0]["mass"], rows[0]["heavy"]), reverse=True)[: similarity.WIDE_TERMS]], np.int64).view(np.uint64)
    (name,) = (b.column("name")[0].as_py() for b in similarity._merge_blocks(folder, [[rows[0]["block"]]], heaviest)([pa.RecordBatch.from_pydict({"id": [0]})]))
    return similarity._Block.read(folder, name, threshold)


def test_different_rare_terms_rule_pairs_out(tmp_path, monkeypatch):
    # The frequent word alone gives 0.92; the norms of the rest would allow all pairs.
    texts = [" ".join(["w"] * 12 + [f"r{i}-{k}" for k in range(12)]) for i in range(300)] + [" ".join(["w"] * 12 + [f"r0-{k}" for k in range(11)])]
    block = term_group(texts, str(tmp_path), monkeypatch)
    found = [(block.paths[int(i)].as_py(), block.paths[int(j)].as_py()) for x, y in similarity._near(block, block, 0.95) for i, j in zip(x, y)]
    assert {frozenset(("d0000", "d0300"))} <= {frozenset(f) for f in found} and len(found) < 300 * 299 / 2 / 10


@pytest.mark.parametrize("most", [30, 6000])
def test_products_at_once_equal_those_one_by_one(tmp_path, monkeypatch, most):
    rng = np.random.default_rng(7)
    common, rare = [f"w{i}" for i in range(60)], [f"r{i}" for i in range(400)]
    texts = [" ".join(["t"] * int(rng.integers(1, most)) + list(rng.choice(common, 50)) + list(rng.choice(rare, 20))) for _ in range(90)]
    a = term_group(texts[:50], str(tmp_path / "a"), monkeypatch)
    b = term_group(texts[50:], str(tmp_path / "b"), monkeypatch)
    code = np.array([{int(t): k for k, t in enumerate(b.terms)}.get(int(t), len(b.terms)) for t in a.terms], np.int32)
    mine, theirs = similarity._Terms(a, code, len(b.terms)), similarity._Terms(b, None, len(b.terms))
    x, y = (v.ravel() for v in np.meshgrid(np.arange(50), np.arange(40), indexing="ij"))
    bags = {f"d{i:04d}": Counter(t.split()) for i, t in enumerate(texts[:50])}, {f"d{i:04d}": Counter(t.split()) for i, t in enumerate(texts[50:])}
    want = [sum(n * bags[1][b.paths[int(j)].as_py()][w] for w, n in bags[0][a.paths[int(i)].as_py()].items()) for i, j in zip(x, y)]
    assert similarity._exact_products(mine, theirs, x, y).tolist() == want
    monkeypatch.setattr(similarity, "MATRIX_TERMS", 16)
    monkeypatch.setattr(similarity, "MATRIX_PRODUCTS", 100)
    for cost in (0, 5, 10**6):
        monkeypatch.setattr(similarity, "PRODUCT_COST", cost)
        assert similarity._all_products(mine, theirs, np.arange(50), np.arange(40)).ravel().tolist() == want


def test_alike_documents_of_several_groups_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(list(rng.choice([f"w{i}" for i in range(5)], 120)) + list(rng.choice([f"r{i}" for i in range(900)], 12))) for _ in range(400)]
    bags = [Counter(t.split()) for t in texts]
    words = {w: k for k, w in enumerate(sorted(set().union(*bags)))}
    counts = np.zeros((len(texts), len(words)))
    for i, bag in enumerate(bags):
        counts[i, [words[w] for w in bag]] = list(bag.values())
    cosine = counts @ counts.T / np.sqrt((counts**2).sum(1))[:, None] / np.sqrt((counts**2).sum(1))
    want = {(f"d{i:04d}", f"d{j:04d}") for i, j in zip(*np.nonzero(np.triu(cosine >= 0.95, 1)))}
    df = spark.createDataFrame([(f"d{i:04d}", t) for i, t in enumerate(texts)], "path string, text string").coalesce(1)
    assert len(want) > 10_000 and pairs_of(similar_documents(df, 0.95, block_rows=150)) == want


def test_empty_inputs(spark):
    assert similar_documents(spark.createDataFrame([("a", " ")], "path string, text string")).count() == 0
    assert similar_vectors(spark.createDataFrame([], "path string, embedding array<float>")).count() == 0
    assert similar_images(spark.createDataFrame([], "path string, perceptual_hash string"), 4).count() == 0
    assert similar_images(spark.createDataFrame([], "path string, perceptual_hash string"), 40).count() == 0


def closure(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    groups = {}
    for node in list(parent):
        groups.setdefault(find(node), set()).add(node)
    return {(min(g), n, len(g)) for g in groups.values() for n in g if len(g) > 1}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_equal_closure(spark, shape):
    rng = np.random.default_rng(4)
    if shape == "chain":
        order = rng.permutation(300)
        edges = [(f"n{a:04d}", f"n{b:04d}") for a, b in zip(order, order[1:])]
    elif shape == "star":
        edges = [("n5000", f"n{i:04d}") for i in range(2000)] + [("x", "x")]
    else:
        edges = [(f"n{a:04d}", f"n{b:04d}") for a, b in rng.integers(0, 400, size=(300, 2)) if a != b]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = [(r.group_id, r.node, r.group_size) for r in components.connected_components(df).collect()]
    want = closure([e for e in edges if e[0] != e[1]])
    assert len(got) == len(want) and set(got) == want


def mixed_graph():
    """Stars, chains with stars at them, pairs with only each other, double and turned edges."""
    edges = [("hub", f"n{i:04d}") for i in range(300)] + [(f"n{i:04d}", "hub") for i in range(9)] + [("x", "x")]
    edges += [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(20)] + [("c07", f"leaf{i}") for i in range(5)] + [("a", "b"), ("z", "y"), ("y", "z"), ("b", "a")]
    return edges + [("t1", "t2"), ("t2", "t3"), ("t3", "t1"), ("t3", "t4")]


@pytest.mark.parametrize("alike", [False, True])
def test_components_of_a_mixed_graph(spark, monkeypatch, alike):
    """Also where the hashes of two nodes are the same."""
    if alike:
        monkeypatch.setattr(components, "_hash", lambda node: F.pmod(F.xxhash64(node), F.lit(50)))
    df = spark.createDataFrame(mixed_graph(), "src string, dst string")
    got = [(r.group_id, r.node, r.group_size) for r in components.connected_components(df).collect()]
    want = closure([e for e in mixed_graph() if e[0] != e[1]])
    assert len(got) == len(want) and set(got) == want


def test_stars_need_no_round(spark, monkeypatch):
    """Only edges between nodes of several neighbours go through the rounds."""
    seen = []
    rounds = components._stars
    monkeypatch.setattr(components, "_stars", lambda edges, n: seen.append(edges.count()) or rounds(edges, n))
    stars = spark.createDataFrame([(f"c{i % 7}", f"o{i}") for i in range(500)], "src string, dst string")
    assert components.connected_components(stars).count() == 507 and not seen
    chain = spark.createDataFrame([("t1", "t2"), ("t2", "t3"), ("t3", "t4"), ("t4", "t5")], "src string, dst string")
    assert components.connected_components(stars.unionByName(chain)).count() == 512 and seen == [2]


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_group_stats_and_lookup_with_a_hot_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("k"),
        F.col("id").cast("string").alias("path"),
    )
    stats = with_group_stats(rows, "k", "path", count="n", minimum={"least": F.col("path")})
    plain = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("path").alias("least"))
    want = {tuple(r) for r in rows.join(plain, "k").collect()}
    assert {tuple(r) for r in stats.select("k", "path", "n", "least").collect()} == want
    assert {tuple(r) for r in lookup(rows, plain, "k", "path").select("k", "path", "n", "least").collect()} == want


def test_largest_block_of_a_hot_group_is_bounded(spark):
    from filelake.operators.skew import pair_tasks

    rows = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").cast("string").alias("path"), F.lit(5000).alias("n"))
    tasks = pair_tasks(rows, ["k"], "path", "n", 500)
    sizes = [r["count"] for r in tasks.groupBy("k", "lo", "hi").count().collect()]
    assert len(sizes) == 55 and max(sizes) < 1400


def test_semantic_search_is_a_top_k(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("z", [0.0, 0.0]), ("n", None)], "path string, content_embedding array<float>")
    top = reports.semantic_search(df, [1.0, 0.0], 2)
    assert [(r.path, r.score) for r in top.collect()] == [("a", 1.0), ("b", 0.6)]
    assert "TakeOrderedAndProject" in plan_of(top)
    with pytest.raises(ValueError):
        reports.semantic_search(df, [])
    assert similarity.MAX_PIVOTS == 256
