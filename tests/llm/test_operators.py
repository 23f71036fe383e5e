"""Operators against brute force on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import plan_of
from filelake.session import cut_lineage
from filelake.llm import counts, hnsw, jaccard, langid, merkle, mixing, packing, queries, records, suffix_dedup, surrogates, warc

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, prefix string, digest string, key string"


@pytest.fixture(scope="module")
def odd_rows():
    texts = pq.read_table(f"{FOLDER}/documents.parquet").column("text").to_pylist()[:40]
    base = " ".join(texts)[:6000]
    passage = texts[0][:700]
    odd = [None, "", " \n\t ", "!!! ??? 123", "one two", "One  TWO", "漢字かな交じり文", "a" * 3000, base, base, base[:5000] + " changed " + base[5000:]]
    odd += [passage + " tail one", "head " + passage, texts[1], texts[1], "word " * 3000]
    rows = [(i, t, "en" if i % 3 else None, ["s1", None, "s2"][i % 3]) for i, t in enumerate(odd + texts)]
    rows += [(8, base, "en", "s2"), (None, texts[2], "en", "s1"), (10**12, texts[3], "en", None)]
    return [(i, t, lang, source, None if t is None else len(t), "x", "y", "z") for i, t, lang, source in rows]


@pytest.fixture(scope="module")
def docs(spark, odd_rows):
    return queries.prepare(spark).createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return queries.prepare(spark).createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_empty_tables_give_no_row(no_docs, spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (
        merkle.fingerprint_edits(no_docs), suffix_dedup.remove_repeats(no_docs), surrogates.replace_entities(no_docs, b"k"),
        langid.predict_languages(no_docs), records.write_and_read(no_docs, PATH), warc.archive_pages(pages), hnsw.near_duplicates(vectors),
        mixing.mix_sources(no_docs), packing.pack_documents(no_docs, PATH), jaccard.jaccard_components(no_docs),
    ):
        assert df.collect() == []


def test_fingerprints(docs, odd_rows):
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    texts = [r[1] or "" for r in rows]
    wanted = Counter()
    for text, following in zip(texts, texts[1:] + texts[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        wanted[(len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
    found = merkle.fingerprint_edits(docs).collect()
    assert Counter((r["n_chars"], r["edited_sha256"]) for r in found) == wanted
    prints = {}
    by_text = {r[0]: r[1] or "" for r in odd_rows}
    for r in found:
        prints.setdefault(by_text[r["doc_id"]], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_edited"] == 1) == (r["fingerprint"] == r["edited_fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len(set.union(*prints.values())) == len(prints)


def test_next_text_over_many_ranges(docs, odd_rows, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 5)
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    texts = [r[1] or "" for r in rows]
    wanted = Counter(zip(texts, texts[1:] + texts[:1]))
    assert Counter((r["text"], r["next_text"]) for r in merkle.with_next_text(docs).collect()) == wanted


def test_repeats(docs, odd_rows):
    data = [(r[1] or "").encode() for r in odd_rows]
    starts = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    wanted = Counter()
    for row, d in zip(odd_rows, data):
        hit = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - 399):
            if starts[d[i : i + 400]] > 1:
                hit[i + 1 : i + 401] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~hit[1:-1]])
        wanted[(row[0], len(d), len(d) - len(kept), int((hit[1:] & ~hit[:-1]).sum()), hashlib.sha256(kept).hexdigest())] += 1
    found = suffix_dedup.remove_repeats(docs).drop("kept").collect()
    assert Counter(map(tuple, found)) == wanted


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_jaccard_components(docs, odd_rows):
    sets = [(r[0], shingles(r[1])) for r in odd_rows if r[0] is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in sets:
        for j, b in sets:
            if i != j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    found = by_id(jaccard.jaccard_components(docs))
    for i, a in sets:
        assert (found[i]["n_shingles"], found[i]["component_id"]) == (len(a), find(i))
    assert found[4]["component_id"] == found[5]["component_id"] == 4


def test_overlaps_and_codes():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 4000, n).astype(np.uint64)) for n in (0, 1, 50, 3000)]
    wanted = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert jaccard.overlaps(sets, sets).tolist() == wanted
    for values in (np.empty(0, np.uint64), np.array([0, 5, 5, 1 << 63], np.uint64), np.sort(rng.integers(0, 1 << 62, 999).astype(np.uint64))):
        assert (counts.unpack_sorted(counts.pack_sorted(values)) == values).all()
        for top in (0, 1, 15, 255, 4095, 70_000):
            small = values % np.uint64(top + 1)
            assert (counts.unpack_bits(counts.pack_bits(small)) == small).all()


PERSONAL = "Mail anna.b@example.org or ANNA.B@example.org, call +1 (784) 555-8120, card 4539 1488 0343 6467, ip 10.20.30.40, Frau Meier Schulz, password=a1b2c3d4e5f6"


def test_surrogates(spark):
    rows = [(1, PERSONAL), (2, "again anna.b@example.org and 4539148803436467."), (3, None), (4, ""), (5, "Герр"), (1, PERSONAL)]
    found = surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), b"key").collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == 6 and by[3]["text"] is None and by[4]["text"] == ""
    new = by[1]["text"]
    assert not re.search(r"(?i)anna\.b|555-8120|1488|10\.20\.30\.40|Meier|a1b2c3", new)
    assert by[1]["n_entities"] == 7 and re.search(r"card \d{4} \d{4} \d{4} \d{4},", new) and "Frau " in new
    mail = re.search(r"Mail (\S+) or (\S+),", new)
    assert mail[2].lower() == mail[1] and mail[2].partition("@")[0].isupper() and mail[1] in by[2]["text"]
    card = re.search(r"card ([\d ]+),", new)[1].replace(" ", "")
    assert surrogates.luhn_ok(card) and card in by[2]["text"]


def test_surrogates_stay_distinct(spark, monkeypatch):
    """Twenty cards whose surrogates are drawn from few numbers still get twenty."""
    card = surrogates.KINDS[3]
    few = card._replace(make=lambda value, canonical, draw: f"{4000 + draw.below(40):04d}0000")
    text = " ".join(f"{4000 + k}0000" for k in range(0, 24, 2))
    kinds = (few._replace(pattern=r"\b40\d\d0000\b", valid=lambda v: True),)
    assert kinds[0].name == "CARD"
    made = [surrogates.Entity(0, 8, kinds[0], w) for w in text.split()]
    assert all(surrogates.surrogate(e, b"k", {}) != e.value for e in made)
    rows = spark.createDataFrame([("CARD", f"45391488034364{k:02d}", f"45391488034364{k:02d}", 1) for k in range(30)], surrogates._ENTITY)
    assert surrogates.resolve_collisions(rows, b"k").where("attempt < 1").count() == 0


SPELLINGS = [
    ("EMAIL", "anna.b@example.org", "ANNA.B@example.org"), ("SECRET", "password=a1b2c3d4e5f6", "api_key: 'a1b2c3d4e5f6"),
    ("SECRET", "ghp_A1b2C3d4E5f6G7h8I9j0", "token=ghp_A1b2C3d4E5f6G7h8I9j0"), ("IBAN", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"),
    ("CARD", "4539148803436467", "4539 1488 0343 6467"), ("IP", "10.20.30.4", "10.20.30.04"), ("PHONE", "+17845558120", "+1 784 555 8120"),
    ("PHONE", "+1 (784) 555-8120", "+1784-555-8120"), ("PHONE", "+493012345678", "+49 30 1234 5678"), ("PHONE", "(784) 555-8120", "784.555.8120"),
    ("NAME", "Mr. Smith", "Mr  SMITH"), ("NAME", "Frau Meier Schulz", "Frau. Meier SCHULZ"), ("NAME", "Dr. Иванов", "Dr Иванов"),
]


@pytest.mark.parametrize("kind, one, other", SPELLINGS)
def test_spellings_share_a_surrogate(kind, one, other):
    (a,), (b,) = surrogates.find_entities(one), surrogates.find_entities(other)
    assert a.kind.name == b.kind.name == kind
    for attempt in range(3):
        for one_part, other_part in zip(a.parts(), b.parts(), strict=True):
            x, y = (surrogates.made_canonical(p, surrogates.part_surrogate(p, b"k", attempt)) for p in (one_part, other_part))
            assert one_part.slot == other_part.slot and x == y != one_part.canonical


NAMES = [
    "Mr 李明", "Mr Παπαδόπουλος", "Mr محمد علي", "Mr Jean-Luc Picard", "Mr O'Neil", "Ms Mary O’Neil-Smith", "Dr. Иванов-Петров", "Herr MEIER", "Mme Élodie Dupré",
    "Mr עמית כהן", "Prof 田中",
]


@pytest.mark.parametrize("name", NAMES)
def test_names_keep_script_and_form_and_leak_nothing(name):
    """Every part is replaced whole, in its own script, with its hyphens, apostrophes and capitals."""
    (entity,) = surrogates.find_entities(f"so {name}, he said")
    assert entity.value == name
    new = surrogates.surrogate(entity, b"k", {})
    old_words, new_words = name.split(), new.split()
    assert new_words[0] == old_words[0] and len(new_words) == len(old_words)
    script = lambda w: {unicodedata.name(c).split()[0] for c in w if c.isalpha()}
    for a, b in zip(old_words[1:], new_words[1:]):
        assert script(a) == script(b) and a.isupper() == b.isupper()
        assert not {x.casefold() for x in re.split("[-'’]", a) if len(x) > 2} & {x.casefold() for x in re.split("[-'’]", b)}
    if len(old_words) == 2:
        assert [c for c in name if c in "-'’"] == [c for c in new if c in "-'’"]


def test_one_surname_is_one_surrogate(spark):
    """A person named in several ways keeps one surname, and people with different names stay apart."""
    texts = ["Mr. John Smith met Mr Smith and Mrs Anna Smith's friend Dr Jane O'Neil.", "Mr Jack Smith, Mr John Miller and Miss Jane O’Neil", "Mr Smith-Jones"]
    rows = [(i, t, "mine", 5, "d") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __moved string, n_entities int, digest string")
    found = by_id(surrogates.replace_entities(df, b"key"))
    assert [found[0][c] for c in ("__moved", "digest", "n_entities")] == ["mine", "d", 4]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mr (\w+) and Mrs (\w+) (\w+)'s friend Dr (\w+) (.+)\.", found[0]["text"])
    john, smith, jane, neil = m[1], m[2], m[6], m[7]
    assert m[3] == m[5] == smith and "smith" not in found[0]["text"].lower()
    n = re.fullmatch(r"Mr (\w+) (\w+), Mr (\w+) (\w+) and Miss (\w+) (.+)", found[1]["text"])
    assert n[2] == smith and n[3] == john and n[1] != john and n[4] != smith and n[6].replace("’", "'") == neil


def test_rekeyed_names_by_join(spark, monkeypatch):
    """More re-keyed entities than a closure holds give the same texts."""
    texts = [f"Mr {a}{b} {c}" for a in ("Tom", "Tim", "Jon", "Jim", "Ben") for b in ("my", "my-Lee", "o") for c in ("Gray", "Wood", "Hale")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(df, b"key").collect()}
    monkeypatch.setattr(surrogates, "CLOSURE_ENTITIES", 0)
    assert {r["doc_id"]: r["text"] for r in surrogates.replace_entities(df, b"key").collect()} == held and len(set(held.values())) == len(texts)


def test_secret_of_signs_alone_is_none(spark):
    rows = [(1, "Password: ________ token: -------- secret=/+/+/+/+"), (2, "password=________a token: --------9")]
    found = by_id(surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), b"key"))
    assert found[1]["text"] == rows[0][1] and found[1]["n_entities"] == 0
    assert found[2]["n_entities"] == 2 and found[2]["text"] != rows[1][1]


def test_more_entities_than_short_forms(spark):
    """More names of one title than four syllables give, and nearly all addresses and secrets of one form."""
    n = 16**4 + 4000
    names = spark.range(n).selectExpr("'SURNAME' AS kind", "concat('x', translate(id, '0123456789', 'abcdefghij')) AS canonical", "concat('X', translate(id, '0123456789', 'abcdefghij')) AS value", "1L AS hits")
    letters = "abcdefghijklmnopqrstuvwxyz"
    few = [("EMAIL", f"{a}@{b}.com", f"{a}@{b}.com", 1) for a in letters for b in letters]
    few += [("SECRET", f"_______{a}", f"token=_______{a}", 1) for a in letters]
    entities = names.unionByName(spark.createDataFrame(few, surrogates._ENTITY))
    entities = cut_lineage(entities)
    moved = {(r["kind"], r["canonical"]): r["attempt"] for r in surrogates.resolve_collisions(entities, b"k").collect()}
    kinds = {k.name: k for k in surrogates.KINDS} | surrogates.PARTS
    rows = entities.collect()
    parts = [surrogates.Part(kinds[r["kind"]], r["canonical"], r["value"]) for r in rows]
    made = {(p.kind.name, surrogates.made_canonical(p, surrogates.part_surrogate(p, b"k", moved.get(p.slot, 0)))) for p in parts}
    assert len(made) == len(rows) == n + 702 and not made & {(r["kind"], r["canonical"]) for r in rows}


def test_language(spark, docs, odd_rows):
    found = langid.predict_languages(docs).collect()
    assert len(found) == len(odd_rows)
    by = {r["doc_id"]: r for r in found}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 3))
    assert by[5]["held_out"] == (zlib.crc32(b"5") % 3 == 1)
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in table.collect()}
    rows = [r for r in langid.predict_languages(table).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_profile_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Ein kleiner Text, über zwei Zeilen\nund mehr. " * 30
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "_STRIDE", 50)
    parts = langid.gram_counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_records(docs, odd_rows):
    library = Tokenizer.from_file(PATH)
    found = records.write_and_read(docs, PATH).collect()
    rows = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in odd_rows))
    start = 0
    for got, (_, _, text) in zip(sorted(found, key=lambda r: r["start"]), rows, strict=True):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_frames():
    assert records.crc32c(b"123456789") == 0xE3069283 and records.crc32c(b"") == 0
    data = bytes(range(256)) * 40
    assert records.unframe(memoryview(records.frame(data))) == data
    broken = bytearray(records.frame(data))
    broken[50] ^= 1
    with pytest.raises(ValueError):
        records.unframe(memoryview(broken))


def test_archives(spark):
    long = "<p>" + "x" * 2000
    rows = [(1, "u", long), (7, None, long), (7, "u", long), (3, "u\r\n v", "short"), (4, "u", "short"), (5, "u", None), (None, "u", long)]
    found = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found)
    assert got == Counter({(1, 2003, "revisit", 7): 1, (7, 2003, "response", None): 2, (3, 5, "response", None): 1, (4, 5, "response", None): 1, (5, 0, "response", None): 1, (None, 2003, "revisit", 7): 1})
    assert {r["payload_digest"] for r in found if r["payload_bytes"] == 2003} == {hashlib.sha1(long.encode()).hexdigest()}
    with pytest.raises(ValueError):
        warc.decode_record(warc.encode_record("response", "urn:page:1", {}, b"abc")[:-1])


def test_near_vectors_of_extreme_lengths(spark):
    base = np.array([0.3, -0.7, 0.2, 0.5])
    rows = [(i, (size * (base + 1e-6 * i)).tolist()) for i, size in enumerate((1e200, 1.0, 1e-200, 1e300, 1e-300))]
    found = by_id_of(hnsw.near_duplicates(spark.createDataFrame([*rows, (9, [0.0, 1e-310, 0.0, 0.0])], "vec_id long, embedding array<double>")), "vec_id")
    assert [found[i]["n_links"] for i in range(5)] == [4] * 5 and found[9]["n_links"] == 0


def test_mixture_keeps_columns_of_any_name(spark):
    rows = [(i, f"word {i}", "s", "t", i, "c") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __text string, __n int, __copy string")
    taken = mixing.take_mixture(df)
    assert taken.columns == df.columns and {(r["__text"], r["__copy"]) for r in taken.collect()} == {("t", "c")}
    assert all(r["__n"] == r["doc_id"] for r in taken.collect())


def by_id_of(df, key):
    return {r[key]: r for r in df.collect()}


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    points = np.concatenate([centres[rng.integers(0, 30, 1200)] + 0.13 * rng.normal(size=(1200, 16)), centres[[0]] + 0.01 * rng.normal(size=(400, 16))]).astype(np.float32)
    points[-1] = points[0]
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    labels = hnsw_labels(linked)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    bad = [(9000, None), (9001, [0.0] * 16), (9002, [1.0, None] + [0.0] * 14), (9003, [float("nan")] * 16), (9004, [1.0, 2.0])]
    found = hnsw.near_duplicates(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>"), shard_rows=500)
    by = {r["vec_id"]: r for r in found.collect()}
    got = np.array([by[i]["n_links"] for i in range(len(points))])
    assert got.sum() >= 0.99 * linked.sum() and (got <= linked.sum(1)).all()
    assert [by[i]["component_id"] for i in range(len(points))] == labels.tolist()
    assert all((by[i]["n_links"], by[i]["component_id"]) == (0, i) for i, _ in bad)


def test_graphs_lie_in_files_not_in_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows, linked = [], {}
    for first, dim, n in ((0, 8, 300), (1000, 12, 90)):
        x = rng.normal(size=(n, dim))
        x[n // 2 :] = x[: n - n // 2] + 0.1 * rng.normal(size=(n - n // 2, dim))
        rows += [(first + i, p.tolist()) for i, p in enumerate(x)]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        linked |= {first + i: int(c) - 1 for i, c in enumerate((unit @ unit.T >= 0.9).sum(1))}
    tables, stored = [], hnsw.stored
    monkeypatch.setattr(hnsw, "stored", lambda df, name: tables.append(df.schema) or stored(df, name))
    found = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=60)
    assert {r["vec_id"]: r["n_links"] for r in found.collect()} == linked
    # A row of a graph is as large as a shard, and several of them fill an executor.
    assert tables and not any("binary" in f.dataType.simpleString() for t in tables for f in t)
    assert "CoGroup" not in plan_of(found)


def hnsw_labels(linked):
    labels = np.arange(len(linked))
    while True:
        new = np.minimum(labels, np.where(linked, labels[None, :], len(labels)).min(1))
        if (new == labels).all():
            return labels
        labels = new


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.build_graph(x)
    ids, sims = hnsw.search_graph(graph, x[:200], 64)
    best = np.take_along_axis(ids, np.argsort(-sims, 1)[:, :10], 1)
    true = np.argsort(-(x[:200] @ x.T), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(best, true)]) >= 0.9


def test_wide_beams_take_few_steps(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, cut, calls = hnsw.build_graph(x), np.argpartition, []
    monkeypatch.setattr(np, "argpartition", lambda *a, **b: calls.append(1) or cut(*a, **b))
    ids, sims = hnsw.beam_search(x, graph.levels[0], x[:100], np.full((100, 1), graph.entry), 192)
    # Two cuts a step; four nodes a step would take 48 steps at least.
    assert len(calls) < 60
    assert all(len(set(row)) == 192 for row in ids.tolist())
    assert np.allclose(sims, np.einsum("bd,bkd->bk", x[:100], x[ids]), atol=1e-5)
    true = np.argsort(-(x[:100] @ x.T), 1)[:, :10]
    assert np.mean([np.isin(a, b).mean() for a, b in zip(true, ids)]) >= 0.99


def test_the_audit_widens_by_quarters(monkeypatch):
    x = hnsw._unit(np.random.default_rng(4).normal(size=(400, 8)))

    def search(graph, queries, width):
        order = np.argsort(-(queries @ x.T), 1)[:, :width]
        return order if width >= 60 else np.full_like(order, -1), None

    monkeypatch.setattr(hnsw, "search_graph", search)
    assert hnsw._audited_width(hnsw.Graph(x, [], 0), x, 0.9) == 60


def hidden_group():
    """A graph whose dense group is not reached from outside it, and the group's nodes."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 24))
    group = np.arange(5023, 5115)
    x[group] = x[5023] + 0.02 * rng.normal(size=(len(group), 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = hnsw.build_graph(x)
    inside = np.isin(np.arange(len(x)), group)
    for level in graph.levels:
        level[~inside[:, None] & np.isin(level, group)] = -1
    return graph._replace(entry=int(np.flatnonzero(~inside & (graph.levels[-1] >= 0).any(1))[0])), group


def test_group_out_of_reach():
    graph, group = hidden_group()
    x = graph.unit
    # No query of the group is in the sample of the audit.
    assert not np.isin(np.arange(0, len(x), len(x) // hnsw.AUDIT_QUERIES), group).any()
    pairs = {(i, j) for a, k in hnsw.linked_pairs(graph, x, 0.9, np.arange(len(x))) for i, j in zip(a.tolist(), k.tolist())}
    assert all((i, j) in pairs for i in group.tolist() for j in group.tolist())
    # One dense query of the sample does not vanish among many that are fine.
    queries = x[np.concatenate((np.arange(63), group[:1]))]
    assert 4 * hnsw._audited_width(graph, queries, 0.9 - hnsw._MARGIN) >= len(x)


def test_links_count_at_both_ends(spark):
    true = {1: 1, 2: 2, 3: 2, 4: 1, 7: 1, 8: 1}
    # 2 found 1 and 3, 1 did not find 2; 3 and 4 did not find each other; 7 and 8 did.
    rows = [(2, 2, 2, 5 ^ 6), (1, 1, 0, 5), (3, 3, 0, 6), (3, 3, 1, 6), (2, 2, 0, 6), (7, 7, 1, 9), (8, 8, 0, 9), (8, 8, 1, 9), (7, 7, 0, 9), (2, 1, 0, 0), (3, 1, 0, 0), (8, 7, 0, 0)]
    asked = []

    def scan(todo):
        ids = sorted(r["rep"] for r in todo.collect())
        asked.append(ids)
        ties = [(4, 3, 0, 0)] if 3 in ids else []
        return spark.createDataFrame([(i, i, true[i], 1) for i in ids] + ties, hnsw._FOUND_DDL)

    links, joined = hnsw.settle_links(spark.createDataFrame(rows, hnsw._FOUND_DDL), scan)
    assert {r["rep"]: r["links"] for r in links.collect()} == true and asked == [[1, 2, 3], [4]]
    assert {r["rep"]: r["component"] for r in joined.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}


def test_mixture(docs, odd_rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in odd_rows]
    found = mixing.mix_sources(docs).collect()
    assert len(found) == len(odd_rows) and Counter(r["size"] for r in found) == Counter(size)
    weight, total = {"s1": 5, "s2": 2, None: 1}, Counter()
    for row, n in zip(odd_rows, size):
        total[row[3]] += n
    target, open_ones, rest = {}, set(total), sum(size)
    while True:
        level = rest / sum(weight[s] for s in open_ones)
        above = {s for s in open_ones if level * weight[s] > 3 * total[s]}
        if not above:
            break
        for s in above:
            target[s], rest = 3.0 * total[s], rest - 3 * total[s]
        open_ones -= above
    target |= {s: level * weight[s] for s in open_ones}
    taken = Counter()
    for r in found:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == total[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(size) for s in target)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    assert len(mixing.take_mixture(docs).collect()) == sum(r["copies"] for r in found)


def check_packing(found, texts):
    library = Tokenizer.from_file(PATH)
    wanted = Counter()
    for i, text in texts:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        edges = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:])):
            wanted[(i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    end = Counter()
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end[r["sequence_id"]]
        end[r["sequence_id"]] += r["length"]
    assert not end or max(end.values()) <= 1024
    return len(end), -(-sum(end.values()) // 1024)


def test_packing(docs, odd_rows):
    check_packing(packing.pack_documents(docs, PATH).collect(), [(r[0], r[1]) for r in odd_rows])


@pytest.mark.parametrize("shape", [(5.5, 1.0), (6.0, 0.7), (4.5, 1.3), (6.5, 0.3)])
def test_packing_is_never_worse_than_best_fit(shape):
    lengths = np.random.default_rng(8).lognormal(*shape, 40_000).astype(int) + 1
    histogram = np.bincount((lengths - 1) % 1024 + 1, minlength=1025)
    histogram[1024] += ((lengths - 1) // 1024).sum()
    plan = packing.plan_patterns(histogram, 1024)
    used = np.zeros(1025, np.int64)
    for p in plan:
        np.add.at(used, list(p.lengths), p.repeats)
    assert (used == histogram).all() and all(sum(p.lengths) <= 1024 for p in plan)
    assert sum(p.repeats for p in plan) <= sum(p.repeats for p in packing.best_fit(histogram.astype(np.int64), 1024))


def test_packing_of_the_given_table(spark):
    """No more sequences than best-fit over the pieces of sf0.1: 9,872 (bound 9,871)."""
    found = packing.pack_documents(queries.prepare(spark).read.parquet("/root/testdata/sf0.1/documents.parquet"), PATH)
    assert found.select("sequence_id").distinct().count() <= 9872


def test_patterns_waste_little():
    rng = np.random.default_rng(4)
    histogram = np.bincount(np.clip(rng.lognormal(5.5, 1, 50_000).astype(int), 1, 1024), minlength=1025)
    plan = packing.plan_patterns(histogram, 1024)
    used = np.zeros(1025, np.int64)
    for p in plan:
        assert sum(p.lengths) <= 1024 and p.repeats > 0
        for v in p.lengths:
            used[v] += p.repeats
    assert (used == histogram).all()
    total = int((histogram * np.arange(1025)).sum())
    assert sum(p.repeats for p in plan) <= 1.01 * total / 1024 + 1


def test_pipeline(docs, odd_rows, spark):
    stages = [f for _, f in corpus_pipeline.STAGES]
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = corpus_pipeline.COLUMNS
    known = corpus_pipeline.keep_known_languages(spark, docs.unionByName(table, allowMissingColumns=True), FOLDER)
    assert known.columns == names and known.where("doc_id in (0, 1, 2, 3)").join(table, "doc_id", "left_anti").count() == 0
    one = stages[1](spark, table, FOLDER)
    groups = {r["component_id"] for r in jaccard.jaccard_components(table).collect()}
    assert {r["doc_id"] for r in one.collect()} == groups
    hidden = stages[2](spark, one, FOLDER).collect()
    assert len(hidden) == len(groups)
    mixed = stages[3](spark, one, FOLDER)
    found = stages[4](spark, mixed, FOLDER).collect()
    check_packing(found, [(r["doc_id"], r["text"]) for r in mixed.collect()])


def test_registered_queries_match_sql(spark):
    import duckdb

    connection = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    for key, sql in queries.ORACLE.items():
        df = queries.QUERIES[key](spark, FOLDER)
        cursor = connection.execute(sql)
        names = [c[0] for c in cursor.description]
        assert Counter(map(tuple, df.select(*names).collect())) == Counter(cursor.fetchall()) and sorted(names) == sorted(df.columns)
