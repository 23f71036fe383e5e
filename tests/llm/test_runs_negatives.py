"""Periodic runs and hard negatives against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filelake.llm import negatives, queries, runs


def brute_runs(words, periods, least):
    n, found = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, e - a, q) for (a, e), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_many_documents(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(120):
        n, signs = rng.randint(0, 90), rng.randint(1, 5)
        words = [rng.randrange(signs) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 9)
            words = [words[i] if i < a else words[min(n - 1, a + (i - a) % p)] for i in range(n)]
        docs.append(words)
    sizes = [len(d) for d in docs]
    offsets = np.cumsum(sizes) - sizes
    flat = np.array([w for d in docs for w in d], np.int64)
    for periods, least in ((4, 6), (2, 2), (3, 5)):
        found = [tuple(r) for r in runs.runs_of(flat, np.repeat(np.arange(len(docs)), sizes), periods, least).tolist()]
        assert found == [(s + at, n, q) for d, at in zip(docs, offsets.tolist()) for s, n, q in brute_runs(d, periods, least)]


def test_one_word_repeated_is_fast_and_whole():
    words = np.zeros(100_000, np.int64)
    assert runs.runs_of(words, words).tolist() == [[0, 100_000, 1]]


def _expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 4, 6)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    milli = None if top[0] is None else 1000 * top[1] // top[2]
    return (doc_id, len(found), *top, milli, digest(lines), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query_with_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "one", "a a a a a a", "a b a b", "é é é é é é é", "x " * 5000, "A a " * 9, "no runs in this one at all"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "b b b b b b", 0, 0), (7, texts[7], 5, 5), (-3, texts[12], 0, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, runs long, collapsed long").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: repr(r)
    assert sorted(found, key=key) == sorted((_expected(i, t) for i, t, _, _ in rows), key=key)


def test_runs_of_an_empty_table(spark):
    assert runs.word_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_negatives(rows, positives=5, negatives_=5):
    out = set()
    for a, label, vec, asks in rows:
        scored = [(-sum(int(x) * int(y) for x, y in zip(vec, v)), i, other) for i, other, v, _ in rows if i != a and len(v) == len(vec)] if asks else []
        for s, i in sorted((s, i) for s, i, other in scored if other == label)[:positives]:
            hard = sorted((t, j) for t, j, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s)
            out |= {(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(hard[:negatives_])}
    return out


@pytest.mark.parametrize("rows, shard, scale", [(300, 20, 40), (400, 64, 3), (250, 4096, 3e8)])
def test_hard_negatives(spark, rows, shard, scale):
    queries.prepare(spark)
    rng = np.random.default_rng(rows)
    points = np.floor(rng.normal(size=(rows, 6)) * scale)
    points[rows // 2 :] = points[: rows - rows // 2]
    points[: rows // 3] = points[0]
    table = [(i, int(rng.integers(0, 4)), points[i].tolist(), i % 9 == 0) for i in range(rows)]
    df = spark.createDataFrame(table, "vec_id long, label int, vec array<double>, asks boolean")
    found = [tuple(r) for r in negatives.mine_hard_negatives(df, df.asks, shard_rows=shard).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_negatives(table)


def test_hard_negatives_of_odd_rows(spark):
    good = [(i, i % 2, [float(i), 3.0], i % 3 == 0) for i in range(12)]
    bad = [(100, None, [1.0, 1.0], True), (101, 1, None, True), (102, 1, [None, 1.0], True), (103, 0, [float("nan"), 1.0], True)]
    bad += [(104, 0, [float("inf"), 1.0], True), (None, 1, [2.0, 2.0], True), (105, 1, [], True)]
    other = [(200, 0, [1.0, 2.0, 3.0], True), (201, 0, [1.0, 2.0, 3.0], False), (202, 1, [1.0, 2.0, 3.0], False)]
    schema = "vec_id long, label int, vec array<double>, asks boolean, rank int, shard string, dim int"
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in good + bad + other + good[:4]], schema)
    found = [tuple(r) for r in negatives.mine_hard_negatives(df, F.col("asks")).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_negatives(good + other)
    assert negatives.mine_hard_negatives(df.limit(0), F.col("asks")).collect() == []
    assert negatives.mine_hard_negatives(df, F.lit(False)).collect() == []


def test_boxes_bound_and_leaves_are_whole():
    rng = np.random.default_rng(5)
    points = np.floor(rng.normal(size=(900, 5)) * 30)
    labels = rng.integers(0, 3, 900)
    forest = negatives.Forest.build(np.arange(900), labels, points, leaf=16, fanout=4)
    leaves = forest.nodes[forest.nodes[:, 2] == 1]
    assert leaves[:, 1].max() <= 16 and leaves[:, 1].sum() == 900 and sorted(forest.ids.tolist()) == list(range(900))
    assert sorted(forest.root_label().tolist()) == [0, 1, 2]
    anchors = rng.normal(size=(7, 5))
    least, most = negatives.bounds(anchors, forest.low, forest.high)
    for node, (first, many, leaf) in enumerate(forest.nodes.tolist()):
        if leaf:
            scores = anchors @ forest.points[first : first + many].T
            assert (scores.min(axis=1) >= least[:, node] - 1e-9).all() and (scores.max(axis=1) <= most[:, node] + 1e-9).all()
        else:
            assert (forest.low[first : first + many] >= forest.low[node]).all() and (forest.high[first : first + many] <= forest.high[node]).all()
    copy = negatives.Forest.from_bytes(forest.to_bytes())
    assert (copy.points == forest.points).all() and (copy.nodes == forest.nodes).all()
