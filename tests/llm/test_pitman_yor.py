"""The Pitman-Yor scores: exact columns by brute force, the sampler against enumeration and against a sequential one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest

from filelake.llm import pitman_yor, queries

SCHEMA = "doc_id long, text string, learns string, score long, chunk long"


def tokens_of(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i, group in enumerate(rest):
            yield [*rest[:i], [items[0], *group], *rest[i + 1 :]]


@pytest.mark.parametrize("count, chance, discount", [(2, 0.3, 0.5), (4, 0.2, 0.7), (5, 0.6, 0.3)])
def test_steps_keep_the_distribution_of_seats(count, chance, discount):
    weights = Counter()
    for seats in partitions(list(range(count))):
        weight = math.prod((1 + discount * k) * chance for k in range(len(seats)))
        weight *= math.prod(math.prod(i - discount for i in range(1, len(table))) for table in seats)
        weights[len(seats)] += weight
    cells, rng = 20_000, np.random.default_rng(count)
    customers = np.full(cells, count)
    seats = pitman_yor.Seats(np.ones(cells, np.int64), customers.copy())
    for _ in range(8):
        before = seats.tables
        seats = pitman_yor.reseat(seats, customers, lambda change, live: (1 + discount * (before[:live] + change)) * chance, discount, 5, rng)
        assert (np.add.reduceat(seats.sizes, np.cumsum(seats.tables) - seats.tables) == count).all() and (seats.sizes > 0).all()
    found = np.bincount(seats.tables, minlength=count + 1) / cells
    total = sum(weights.values())
    assert all(abs(found[t] - weights[t] / total) < 0.015 for t in range(1, count + 1))


@pytest.mark.parametrize("cells", [3, 300])
def test_a_round_seats_every_customer_of_large_cells_again(cells):
    # All start at one table; a new one weighs so much that each customer seated again takes one.
    customers = np.full(cells, 3000)
    start = pitman_yor.Seats(np.ones(cells, np.int64), customers.copy())
    seats = pitman_yor.reseat(start, customers, lambda change, live: np.full(live, 1e9) + change, 0.5, pitman_yor.SWEEPS, np.random.default_rng(3))
    assert (np.add.reduceat(seats.sizes, np.cumsum(seats.tables) - seats.tables) == 3000).all() and (seats.sizes > 0).all()
    assert (seats.tables > 2990).all()


def test_start_and_change_of_seats():
    rng = np.random.default_rng(1)
    customers = -np.sort(-rng.integers(2, 4000, 300))
    seats = pitman_yor.expected_seats(customers, np.full(300, 0.4), 0.7, rng)
    first = lambda s: np.cumsum(s.tables) - s.tables
    assert (np.add.reduceat(seats.sizes, first(seats)) == customers).all() and seats.sizes.min() >= 1
    other = np.maximum(2, customers + rng.integers(-3000, 3000, 300))
    moved = pitman_yor._resized(seats, other)
    assert (np.add.reduceat(moved.sizes, first(moved)) == other).all() and moved.sizes.min() >= 1


def test_the_parent_is_a_distribution():
    customers, tables = np.array([5, 3, 1, 1]), np.array([2, 1, 1, 1])
    root = pitman_yor.Root(10, 5, 4, 0.6, 0.8)
    assert math.isclose(root.share(customers, tables).sum() + root.share(np.zeros(1), np.zeros(1))[0], 1)


class Sequential:
    """The plain sampler: every customer of every restaurant in turn, the parent's seats kept with them."""

    def __init__(self, docs, discount, root_discount, rng):
        self.d, self.e, self.rng = discount, root_discount, rng
        self.words = len({t for d in docs for t in d})
        self.seats, self.open, self.counts = defaultdict(list), Counter(), Counter()
        self.root, self.root_tables, self.root_customers = defaultdict(list), 0, 0
        self.customers = [(v, w) for d in docs for v, w in pairwise([None, *d])]
        for v, w in self.customers:
            self.counts[v] += 1
            self.add(v, w)

    def parent(self, w):
        own = self.root[w]
        rest = (1 + self.e * self.root_tables) / (self.words + 1)
        return (sum(own) - self.e * len(own) + rest) / (1 + self.root_customers)

    def pick(self, own, discount, fresh):
        weights = [n - discount for n in own] + [fresh]
        return self.rng.choices(range(len(weights)), weights)[0]

    def add(self, v, w):
        own = self.seats[v, w]
        k = self.pick(own, self.d, (1 + self.d * self.open[v]) * self.parent(w))
        if k < len(own):
            own[k] += 1
            return
        own.append(1)
        self.open[v] += 1
        top = self.root[w]
        k = self.pick(top, self.e, (1 + self.e * self.root_tables) / (self.words + 1))
        self.root_customers += 1
        if k < len(top):
            top[k] += 1
        else:
            top.append(1)
            self.root_tables += 1

    def leave(self, own):
        k = self.rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            del own[k]
            return True
        return False

    def sweep(self):
        for v, w in self.customers:
            if self.leave(self.seats[v, w]):
                self.open[v] -= 1
                self.root_customers -= 1
                self.root_tables -= self.leave(self.root[w])
            self.add(v, w)

    def chance(self, v, w):
        own = self.seats.get((v, w), [])
        return (sum(own) - self.d * len(own) + (1 + self.d * self.open[v]) * self.parent(w)) / (1 + self.counts[v])


def random_texts(rng, count):
    words = ["w%d" % int(rng.paretovariate(0.8)) for _ in range(500)]
    follow = {w: rng.sample(words, 4) for w in set(words)}
    out = []
    for _ in range(count):
        text = [rng.choice(words)]
        for _ in range(rng.randint(0, 25)):
            text.append(rng.choice(follow[text[-1]]) if rng.random() < 0.7 else rng.choice(words))
        out.append(" ".join(text))
    return out


def test_scores_agree_with_a_sequential_sampler(spark, monkeypatch):
    queries.prepare(spark)
    texts = random_texts(random.Random(4), 300)
    rows = [(i, t, i % 10 > 0) for i, t in enumerate(texts)]
    # Several buckets and chunks, as on a large table.
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 900)
    monkeypatch.setattr(pitman_yor, "BUCKET_WORDS", 300)
    df = spark.createDataFrame(rows, "doc_id long, text string, learns boolean").repartition(4)
    found = {r["doc_id"]: r for r in pitman_yor.score_documents(df, df.learns, rounds=24, burn_in=8).collect()}
    train = [tokens_of(t) for _, t, learns in rows if learns]
    cells = Counter(p for d in train for p in pairwise([None, *d]))
    guests = Counter(w for _, w in cells)
    by_size = lambda c, n: sum(x == n for x in c.values())
    discounts = [pitman_yor._discount(by_size(c, 1), by_size(c, 2)) for c in (cells, guests)]
    plain = Sequential(train, *discounts, random.Random(9))
    sums, samples = Counter(), 0
    for sweep in range(40):
        plain.sweep()
        if sweep >= 15:
            samples += 1
            for i, t, _ in rows:
                for k, (v, w) in enumerate(pairwise([None, *tokens_of(t)])):
                    sums[i, k] += plain.chance(v, w)
    for held in (True, False):
        ids = [i for i, _, learns in rows if learns != held]
        n = sum(found[i]["n_tokens"] for i in ids)
        mine = sum(found[i]["score"] for i in ids) / n
        other = sum(math.log10(sums[i, k] / samples) for i in ids for k in range(found[i]["n_tokens"])) / n
        assert abs(mine - other) < 0.02
        assert mine > sum(found[i]["base_score"] for i in ids) / n


def test_exact_columns_with_odd_rows(spark, tmp_path):
    texts = random_texts(random.Random(6), 60)
    odd = [None, "", " \n\t ", "One  TWO one", "É é unseen", "漢字 かな", "x " * 3000, texts[0], texts[0]]
    rows = [(i, t, "a", 1, 2) for i, t in enumerate(odd + texts)] + [(None, "null id", "b", 0, 0), (12, texts[3], "c", 0, 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = [r.asDict() for r in queries.op11_pitman_yor(spark, str(tmp_path)).collect()]
    remainder = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10
    train = Counter(t for i, text, *_ in rows if remainder(i) for t in tokens_of(text))
    total, known = sum(train.values()), len(train)
    wanted = []
    for i, text, *_ in rows:
        tokens = tokens_of(text)
        base = sum(math.log10((train[t] + 0.1) / (total + 0.1 * (known + 1))) for t in tokens)
        wanted.append((repr(i), None if i is None else remainder(i) == 0, len(tokens), sum(t in train for t in tokens), total, round(base, 6)))
    got = [(repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert all(r["score"] < 0 for r in found)


def test_without_rows_and_without_training_rows(spark):
    queries.prepare(spark)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pitman_yor.score_documents(none, none.doc_id > 0).collect() == []
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found = pitman_yor.score_documents(docs, docs.doc_id > 5).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in found) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert all(abs(r["score"]) < 1e-9 and abs(r["base_score"]) < 1e-9 for r in found)


def test_weights_of_new_tables_are_asked_for_once():
    """They are linear in the tables, so a step of all cells needs no new ones; all customers stay seated."""
    rng, asked = np.random.default_rng(3), []
    customers = np.sort(rng.integers(2, 200, 300))[::-1].astype(np.int64)
    fresh = pitman_yor.expected_seats(customers, np.full(300, 2.0), 0.6, rng)

    def fresh_of(change, live):
        asked.append(live)
        return (1.0 + 0.6 * (50 + change)) * np.full(live, 0.1)

    seats = pitman_yor.reseat(fresh, customers, fresh_of, 0.6, 2, rng)
    assert asked == [300, 300]
    assert (np.add.reduceat(seats.sizes, np.cumsum(seats.tables) - seats.tables) == customers).all() and seats.sizes.min() >= 1


@pytest.mark.parametrize("count, chance, discount", [(2, 0.3, 0.5), (5, 0.6, 0.3), (7, 40.0, 0.8)])
def test_a_round_draws_seats_whatever_they_were_before(count, chance, discount):
    weights = Counter()
    for seats in partitions(list(range(count))):
        weight = math.prod((1 + discount * k) * chance for k in range(len(seats)))
        weights[len(seats)] += weight * math.prod(math.prod(i - discount for i in range(1, len(table))) for table in seats)
    cells, rng = 40_000, np.random.default_rng(count)
    customers = np.concatenate(([9, 8], np.full(cells, count), [2]))
    tables = rng.integers(1, 3, len(customers))

    def fresh_of(change, live):
        return (1 + discount * (tables[:live] + change)) * chance

    seats = pitman_yor.seat_again(pitman_yor.Seats(tables, np.empty(0, np.int64)), customers, fresh_of, discount, rng)
    assert len(seats.sizes) == 0 and (seats.tables >= 1).all() and (seats.tables <= customers).all()
    found = np.bincount(seats.tables[2:-1], minlength=count + 1) / cells
    total = sum(weights.values())
    assert all(abs(found[t] - weights[t] / total) < 0.012 for t in range(1, count + 1))


def test_cells_drawn_at_once_and_those_that_step_have_the_exact_mean(monkeypatch):
    count, discount = 90, 0.7
    ways = [0.0, 1.0]
    for c in range(1, count):
        ways = [0.0] + [ways[t - 1] + (c - discount * t) * (ways[t] if t <= c else 0) for t in range(1, c + 2)]
    weights = [w * math.prod(0.2 * (3 + discount * k) for k in range(t)) for t, w in enumerate(ways)]
    exact = sum(t * w for t, w in enumerate(weights)) / sum(weights)
    customers = np.full(1000, count)

    def mean_tables(drawn, rounds):
        monkeypatch.setattr(pitman_yor, "DRAWN", drawn)
        rng = np.random.default_rng(5)
        seats = pitman_yor.first_seats(customers, np.full(1000, 0.8), discount, rng)
        for _ in range(rounds):
            own = seats.tables
            seats = pitman_yor.seat_again(seats, customers, lambda change, live: 0.2 * (3 + discount * (own[:live] + change)), discount, rng)
        assert len(seats.sizes) == (0 if drawn >= count else seats.tables.sum())
        return seats.tables.mean()

    assert abs(mean_tables(count, 1) - exact) < 0.2
    assert abs(mean_tables(count - 1, 80) - exact) < 0.2


def test_words_that_become_large_or_small_keep_their_tables(monkeypatch):
    monkeypatch.setattr(pitman_yor, "DRAWN", 20)
    # Word 0 stays large, 1 becomes large, 2 becomes small, 3 is new.
    places, seats = np.array([0, 2, 1]), pitman_yor.Seats(np.array([3, 4, 5]), np.array([20, 6, 4, 10, 5, 5, 5]))
    customers = np.array([33, 25, 9, 2])
    moved = pitman_yor._moved(places, seats, np.array([0, 1, 2, 3]), customers, 0.6)
    assert moved.tables.tolist() == [3, 5, 4, 1]
    assert moved.sizes[:3].tolist() == [23, 6, 4] and moved.sizes[3:].sum() == 25 and moved.sizes.min() >= 1 and len(moved.sizes) == 8
