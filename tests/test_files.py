"""Operators that read files: listing, archives, extraction, images, scans, refines, ingest."""

import bz2
import gzip
import hashlib
import io
import os
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filelake.functions import text
from filelake.functions.images import dct_hash, image_hashes
from filelake.operators import incremental
from filelake.plans import pipeline, reports
from filelake.plans.pipeline import ScanOptions
from filelake.sources import archives
from filelake.sources.archives import expand_archives
from filelake.sources.files import MemberReader
from filelake.sources.index_store import IndexStore
from filelake.sources.listing import list_files, resolve_roots
from filelake.sources.probe import with_bytes
from filelake.streaming.ingest import ingest

DOCX = text.DOCX


def zip_bytes(members, **times):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name, times.get("time", (2020, 1, 2, 3, 4, 6))), data)
    return out.getvalue()


def tar_bytes(members, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(data), 1234
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def docx_bytes(*paragraphs):
    word = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    return zip_bytes(
        {"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {word}><w:body>{body}{table}</w:body></w:document>"}
    )


def odt_bytes(*paragraphs):
    names = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    body = "".join(f"<text:p>{p}</text:p>" for p in paragraphs)
    content = f"<office:document-content {names}><office:body><office:text>{body}</office:text></office:body></office:document-content>"
    return zip_bytes({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": content})


def png_bytes(pixels):
    height, width, _ = pixels.shape
    raw = b"".join(b"\x00" + row.tobytes() for row in pixels.astype(np.uint8))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def picture(seed, size=(48, 64)):
    """Smooth random colours."""
    coarse = np.random.default_rng(seed).integers(0, 200, size=(6, 8, 3))
    return np.kron(coarse, np.ones((size[0] // 6, size[1] // 8, 1)))


MAIL = (
    b"From: a@b.c\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=X\n\n--X\nContent-Type: text/plain\n\nfirst part\n"
    b"--X\nContent-Type: text/html\n\n<b>no</b>\n--X\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\nc2Vjb25k\n--X--\n"
)
HTML = (
    b"<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style></head><body><p> one <b>two</b> three<!-- no -->four"
    b"<script>var a='</p>';</script><template>hidden</template></p><br/>five</body></html>"
)


def names(df):
    return sorted(os.path.basename(r.path) for r in df.select("path").collect())


def test_listing(spark, tmp_path):
    root = tmp_path / "r"
    for folder in ("_under", ".hidden", "node_modules", "deep/er/est"):
        (root / folder).mkdir(parents=True)
        (root / folder / "in.txt").write_text("x")
    (root / ".dot").write_text("abc")
    (root / "a,b.tar.gz").write_text("x")
    (root / "link").symlink_to(root / ".dot")
    (root / "linkdir").symlink_to(root / "deep")
    os.utime(root / ".dot", (1.25, 1.25))
    listed = list_files(spark, [str(root)], ["node_modules", "est?", "*/deep/er/no"])
    rows = {os.path.relpath(r.path, root): r for r in listed.collect()}
    assert set(rows) == {"_under/in.txt", ".hidden/in.txt", "deep/er/est/in.txt", ".dot", "a,b.tar.gz"}
    dot = rows[".dot"]
    assert (dot.filename, dot.ext, dot.parent, dot.size_bytes, dot.mtime) == (".dot", "", str(root), 3, 1.25)
    assert rows["a,b.tar.gz"].ext == ".gz"
    twice = list_files(spark, [str(root), str(root / "deep")])
    assert names(twice).count("in.txt") == 4
    assert list_files(spark, [str(root)], [str(root / "deep")]).where("path like '%deep%'").count() == 0


def test_roots(tmp_path):
    (tmp_path / "d").mkdir()
    good, bad = resolve_roots([str(tmp_path / "d"), str(tmp_path / "d" / ".." / "d"), str(tmp_path / "none")])
    assert good == [str(tmp_path / "d")] and bad == [str(tmp_path / "none")]


def test_system_roots_bring_their_rules(spark, tmp_path):
    for folder in ("Windows", "programdata", "docs"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f").write_text("x")
    # Rules are lower case and names are compared as they are.
    assert {os.path.dirname(r.path) for r in list_files(spark, [str(tmp_path)]).collect()} == {
        str(tmp_path / "docs"), str(tmp_path / "Windows"),
    }
    assert names(list_files(spark, [str(tmp_path)], case_sensitive=False)) == ["f"]


def test_archives(spark, tmp_path):
    inner = tar_bytes({"deep.txt": b"deep text", "sub/x.bin": b"\x00\x01"})
    (tmp_path / "a.zip").write_bytes(zip_bytes({"t/inner.tar": inner, "plain.txt": b"hello", "../x": b"bad", "b.epub": zip_bytes({"no": b"no"})}))
    (tmp_path / "b.tar.gz").write_bytes(tar_bytes({"y.txt": b"why"}, "w:gz"))
    (tmp_path / "only.gz").write_bytes(gzip.compress(b"not a tar"))
    (tmp_path / "cut.zip").write_bytes(zip_bytes({"c.txt": b"c" * 100})[:60])
    containers = spark.createDataFrame([(str(p),) for p in tmp_path.iterdir()], "path string")
    rows = expand_archives(containers).collect()
    good = {os.path.relpath(r.path, tmp_path): r for r in rows if r.error is None}
    assert set(good) == {
        "a.zip/t/inner.tar", "a.zip/t/inner.tar/deep.txt", "a.zip/t/inner.tar/sub/x.bin", "a.zip/plain.txt", "a.zip/b.epub",
        "b.tar.gz/y.txt",
    }
    deep = good["a.zip/t/inner.tar/deep.txt"]
    assert (deep.mtime, deep.size_bytes, deep.mime_type, list(deep.place)) == (1234.0, 9, "text/plain", [0, 0])
    assert deep.crypto_hash == hashlib.sha256(b"deep text").hexdigest()
    assert good["a.zip/plain.txt"].mtime == 1577934246.0
    with MemberReader() as reader:
        assert all(hashlib.sha256(reader.read(r.member.asDict())).hexdigest() == r.crypto_hash for r in good.values())
    bad = {os.path.relpath(r.path, tmp_path) for r in rows if r.error}
    assert bad == {"x", "only.gz", "cut.zip"} and not (tmp_path.parent / "x").exists()


def expanded(spark, *paths, **options):
    return expand_archives(spark.createDataFrame([(str(p),) for p in paths], "path string"), **options).collect()


def test_members_at_any_depth(spark, tmp_path):
    data = zip_bytes({"big.txt": b"z" * 5000})
    for i in range(9):
        data = zip_bytes({f"n{i}.zip": data}) if i % 2 else tar_bytes({f"n{i}.zip": data}, ("w:gz", "w:xz", "w", "w:bz2")[i // 2 % 4])
    (tmp_path / "n.zip").write_bytes(data)
    rows = expanded(spark, tmp_path / "n.zip")
    assert len(rows) == 10 and not [r.error for r in rows if r.error]
    big = [r for r in rows if r.filename == "big.txt"][0]
    assert big.path.count("/n") >= 10 and big.crypto_hash == hashlib.sha256(b"z" * 5000).hexdigest() and len(big.place) == 10


def test_an_archive_that_contains_itself_ends(spark, tmp_path, monkeypatch):
    """Entries are read by range, so a file may be shown whose entry is the file itself."""
    outer = tmp_path / "outer.tar"
    inner = tar_bytes({"a.txt": b"a"})
    outer.write_bytes(tar_bytes({"i.tar": inner, "j/i.tar": inner}))
    digest = hashlib.sha256(inner).hexdigest()
    df = spark.createDataFrame([(str(outer), digest)], "path string, crypto_hash string")
    rows = expand_archives(df).collect()
    assert sorted(os.path.relpath(r.path, tmp_path) for r in rows if r.error) == ["outer.tar/i.tar", "outer.tar/j/i.tar"]
    assert {r.error for r in rows} == {None, "the archive contains itself"} and not [r for r in rows if r.filename == "a.txt"]


def test_one_archive_is_many_tasks(spark, tmp_path):
    """10,000 members in one archive, dealt out by pieces and read by range."""
    members = {f"d{i % 100}/m{i}.txt": f"member {i}".encode() * (i % 50 + 1) for i in range(10_000)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    (tmp_path / "many.zip").write_bytes(out.getvalue())
    (tmp_path / "many.tar").write_bytes(tar_bytes(members))
    for name in ("many.zip", "many.tar"):
        level = spark.createDataFrame([(str(tmp_path / name),) * 2], "path string, file string").selectExpr("*", "array('x') around", "array(cast(null as long)) place")
        directory = archives.member_directory(level, 16)
        rows = archives.read_directory(directory, 16).withColumn("task", F.spark_partition_id()).collect()
        assert {r.path.split(name + "/")[1]: r.crypto_hash for r in rows} == {k: hashlib.sha256(v).hexdigest() for k, v in members.items()}
        assert len({r.task for r in rows}) >= 8 and max(r.member.piece for r in rows) == 19


def test_damaged_members_leave_the_others(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", b"a" * 1000)
        z.writestr("b.txt", b"b" * 1000)
        z.writestr(zipfile.ZipInfo("lzma.txt"), b"l" * 1000, zipfile.ZIP_LZMA)
        z.writestr(zipfile.ZipInfo("bzip.txt"), b"z" * 1000, zipfile.ZIP_BZIP2)
    data = bytearray(out.getvalue())
    at = data.index(b"b.txt") + 8
    data[at : at + 4] = b"\xff\xff\xff\xff"
    (tmp_path / "x.zip").write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in expanded(spark, tmp_path / "x.zip")}
    assert set(rows) == {"a.txt", "b.txt", "lzma.txt", "bzip.txt"} and rows["b.txt"].error
    assert [rows[n].crypto_hash for n in ("a.txt", "lzma.txt", "bzip.txt")] == [hashlib.sha256(c * 1000).hexdigest() for c in (b"a", b"l", b"z")]


def test_members_are_told_like_files(spark, tmp_path, monkeypatch):
    """Documents in archives by their whole directory, also one longer than what is held; large text members; images."""
    monkeypatch.setattr(archives, "_TAIL", 4096)
    late = {"docProps/thumb.bin": os.urandom(9000)} | {f"x{i}.bin": b"" for i in range(300)}
    late["word/document.xml"] = zipfile.ZipFile(io.BytesIO(docx_bytes("late text"))).read("word/document.xml")
    mail = ("x" * 70 + "\n") * 30_000 + "mail jo@example.org\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.zip").write_bytes(zip_bytes({"late.docx": zip_bytes(late), "big.txt": mail, ".hid/p.png": png_bytes(picture(1))}))
    (tmp_path / "in" / "q.png").write_bytes(png_bytes(picture(1)))
    with tarfile.open(tmp_path / "in" / "b.tgz", "w:gz") as t:
        t.add(tmp_path / "in" / "a.zip", "n/a.zip")
        t.add(tmp_path / "in" / "q.png", "q.png")
    store = IndexStore(spark, str(tmp_path / "store"))
    errors = pipeline.scan(store, [str(tmp_path / "in")], ScanOptions(max_text_bytes=100_000))
    rows = {os.path.relpath(r.path, tmp_path / "in"): r for r in store.read().collect()}
    assert errors.count() == 0 and len(rows) == 11
    for prefix in ("a.zip", "b.tgz/n/a.zip"):
        document = rows[f"{prefix}/late.docx"]
        assert (document.mime_type, document.content) == (DOCX, "late text")
        assert rows[f"{prefix}/big.txt"].content is None and rows[f"{prefix}/big.txt"].pii_types == ["EMAIL_ADDRESS"]
    assert len({r.perceptual_hash for r in rows.values() if r.filename.endswith("png")}) == 1


def test_named_references_need_their_semicolon():
    page = "<title>and&amp;&amp</title><p>&ampere; &copy &copy;&quot;&eacute;&nosuch; &ampé; &am &#65;&</p>".encode()
    assert text.html_text(page) == 'and&&amp\n&ampere; &copy ©"é&nosuch; &ampé; &am A&'


@pytest.mark.parametrize("from_disk", [False, True])
def test_extraction(spark, tmp_path, from_disk):
    cases = [
        ("text/plain", b"  one\r\ntwo\rthree \n", "one\ntwo\nthree"),
        ("text/plain", b"bad \xff\xfe bytes", "bad  bytes"),
        ("text/plain", b" \n\t ", None),
        ("text/plain", b"", None),
        ("text/html", HTML, "T & U\none\ntwo\nthree\nfour\nfive"),
        (DOCX, docx_bytes("First", "Second &amp; third"), "First\nSecond & third"),
        (text.ODF_TYPES[0], odt_bytes("Erste", 'a<text:s text:c="3"/>b<text:tab/>c'), "Erste\na   b\tc"),
        ("message/rfc822", MAIL, "first partsecond"),
        ("message/rfc822", b"Subject: s\n\nplain body\n", "plain body"),
        (DOCX, b"not a zip", None),
        ("application/pdf", b"%PDF", None),
        ("image/png", b"text", None),
        (None, b"text", None),
    ]
    rows = []
    for i, (mime, data, _) in enumerate(cases):
        (tmp_path / str(i)).write_bytes(data)
        rows.append((i, mime, None if from_disk else bytearray(data), str(tmp_path / str(i))))
    df = spark.createDataFrame(rows, "i int, mime string, content binary, path string")
    if from_disk:
        df = with_bytes(df.drop("content"), F.col("mime").isNotNull())
    got = {r.i: r.t for r in df.select("i", text.extract_text(F.col("mime"), F.col("content")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_further_extractors(spark):
    df = spark.createDataFrame([("application/pdf", bytearray(b"abc"))], "mime string, content binary")
    table = {**text.EXTRACTORS, "application/pdf": lambda data: data.decode().upper()}
    assert df.select(text.extract_text(F.col("mime"), F.col("content"), table).alias("t")).first().t == "ABC"


def test_perceptual_hash(spark, tmp_path):
    base = picture(1)
    (tmp_path / "a.png").write_bytes(png_bytes(base))
    (tmp_path / "bright.png").write_bytes(png_bytes(base + 20))
    (tmp_path / "large.png").write_bytes(png_bytes(np.kron(base, np.ones((2, 2, 1)))))
    (tmp_path / "other.png").write_bytes(png_bytes(picture(2)))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    images = spark.read.format("image").option("dropInvalid", "true").load(str(tmp_path))
    got = {os.path.basename(r.path): r.perceptual_hash for r in image_hashes(images).collect()}
    assert set(got) == {"a.png", "bright.png", "large.png", "other.png"}
    apart = lambda x, y: bin(int(got[x], 16) ^ int(got[y], 16)).count("1")
    assert apart("a.png", "bright.png") <= 4 and apart("a.png", "large.png") <= 8 and apart("a.png", "other.png") > 12
    assert len(dct_hash(np.zeros((32, 32)))) == 16


def test_scan_of_the_three_file_tree(spark, corpus_tree, tmp_path):
    store = IndexStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0 and store.scan_log().count() == 0
    errors = pipeline.scan(store, [str(corpus_tree)])
    assert errors.count() == 0
    index = store.read()
    assert index.count() == 3
    row = index.where("filename = 'file1.txt'").first()
    assert (row.mime_type, row.size_bytes, row.content) == ("text/plain", 23, "This is the first file.")
    assert row.crypto_hash == "732a3c9cfeac831d4bb354eac4e5948811988423503829a8e655913b3aa4281d"
    assert row.content_embedding is not None and len(row.content_embedding) == 384
    assert row.pii_types is None and row.is_archived_file is False and row.pronom_id is None
    assert [tuple(r)[:2] for r in reports.type_summary(index).collect()] == [("text/plain", 3)]
    dupes = reports.find_dupes(index).collect()
    assert sorted(os.path.basename(r.path) for r in dupes) == ["file1.txt", "file3_dupe.txt"]
    groups = reports.similar_text_groups(index).collect()
    assert {os.path.basename(r.path) for r in groups} == {"file1.txt", "file3_dupe.txt"}
    history = reports.scan_history(store.scan_log()).collect()
    assert [(r.status, r.files_scanned) for r in history] == [("COMPLETED", 3)]

    # Nothing changed: no new version. Then one file changes and one is new.
    version = store.current_version()
    pipeline.scan(store, [str(corpus_tree)])
    assert store.current_version() == version
    changed = corpus_tree / "file2.txt"
    changed.write_text("changed: jo@example.org")
    os.utime(changed, (4e9, 4e9))
    (corpus_tree / "new.md").write_text("new")
    pipeline.scan(store, [str(corpus_tree)])
    rows = {r.filename: r for r in store.read().collect()}
    assert len(rows) == 4 and rows["file2.txt"].pii_types == ["EMAIL_ADDRESS"] and rows["file2.txt"].mtime == 4e9
    assert store.read(version).count() == 3
    assert [r.files_scanned for r in reports.scan_history(store.scan_log()).collect()] == [2, 0, 3]


def test_failed_scan_is_logged(spark, corpus_tree, tmp_path):
    store = IndexStore(spark, str(tmp_path / "store"))

    def broken():
        raise ValueError("no model")

    with pytest.raises(Exception, match="no model"):
        pipeline.scan(store, [str(corpus_tree)], ScanOptions(make_encoder=broken))
    assert reports.scan_history(store.scan_log()).first().status == "FAILED" and store.read().count() == 0


@pytest.fixture
def mixed_tree(tmp_path):
    root = tmp_path / "mixed"
    root.mkdir()
    (root / "a.zip").write_bytes(zip_bytes({"in.txt": b"inside the archive", "t.log": b"junk", "l.csv": b"\xe9,x@y.io", "i.tar": tar_bytes({"deep.html": HTML})}))
    (root / "book.epub").write_bytes(zip_bytes({"mimetype": "application/epub+zip", "x": b"x"}))
    (root / "bad.zip").write_bytes(zip_bytes({"c.txt": b"c" * 100})[:60])
    (root / "p.png").write_bytes(png_bytes(picture(1)))
    (root / "q.png").write_bytes(png_bytes(picture(1) + 5))
    (root / "d.docx").write_bytes(docx_bytes("Report"))
    (root / "m.eml").write_bytes(MAIL)
    (root / "data.csv").write_bytes(b"name,mail\njo,jo@example.org\n")
    (root / "x.tmp").write_bytes(b"junk")
    (root / "z.bz2").write_bytes(bz2.compress(b"not a tar"))
    return root


def test_scan_of_a_mixed_tree(spark, mixed_tree, tmp_path):
    store = IndexStore(spark, str(tmp_path / "store"))
    errors = pipeline.scan(store, [str(mixed_tree)], ScanOptions(identify_formats=True))
    rows = {os.path.relpath(r.path, mixed_tree): r for r in store.read().collect()}
    assert set(rows) == {
        "a.zip", "a.zip/in.txt", "a.zip/l.csv", "a.zip/i.tar", "a.zip/i.tar/deep.html", "book.epub", "bad.zip", "p.png", "q.png", "d.docx",
        "m.eml", "data.csv", "z.bz2",
    }
    # Not UTF-8, so no text by type, but the legible part is scanned.
    assert rows["a.zip/l.csv"].pii_types == ["EMAIL_ADDRESS"]
    assert rows["a.zip/in.txt"].content == "inside the archive" and rows["a.zip/in.txt"].is_archived_file
    assert rows["a.zip/i.tar/deep.html"].mime_type == "text/html" and "five" in rows["a.zip/i.tar/deep.html"].content
    assert rows["a.zip"].mime_type == "application/zip" and not rows["a.zip"].is_archived_file
    assert rows["d.docx"].content == "Report" and rows["d.docx"].pronom_id == "fmt/412"
    assert rows["p.png"].perceptual_hash and rows["d.docx"].perceptual_hash is None
    assert rows["data.csv"].content is None and rows["data.csv"].pii_types == ["EMAIL_ADDRESS"]
    assert {os.path.basename(r.path) for r in errors.collect()} == {"bad.zip", "z.bz2"}
    similar = reports.image_similar_groups(store.read(), 4).collect()
    assert {os.path.basename(r.path) for r in similar} == {"p.png", "q.png"}
    assert reports.error_rollup(errors).count() == 2


def test_refines(spark, mixed_tree, tmp_path):
    store = IndexStore(spark, str(tmp_path / "store"))
    pipeline.scan(store, [str(mixed_tree)], ScanOptions(extract_text=False, perceptual_hash=False))
    before = {r.path: r for r in store.read().collect()}
    assert all(r.content is None and r.perceptual_hash is None and r.pronom_id is None for r in before.values())

    pipeline.refine_formats(store)
    (mixed_tree / "m.eml").unlink()
    pipeline.refine_text(store)
    pipeline.refine_images(store, [str(mixed_tree)])
    rows = {os.path.relpath(r.path, mixed_tree): r for r in store.read().collect()}
    assert len(rows) == len(before)
    assert rows["d.docx"].content == "Report" and rows["d.docx"].pronom_id == "fmt/412" and rows["d.docx"].text_extracted
    assert rows["m.eml"].content is None and not rows["m.eml"].text_extracted
    assert rows["p.png"].perceptual_hash and rows["p.png"].pronom_id == "fmt/11"
    assert incremental.text_to_refine_under(store.read(), [str(mixed_tree / "d.docx")]).count() == 0


def test_continuous_ingest(spark, mixed_tree, tmp_path):
    store = IndexStore(spark, str(tmp_path / "store"))
    where = (store, str(mixed_tree), str(tmp_path / "checkpoint"))
    ingest(*where).awaitTermination()
    rows = {os.path.relpath(r.path, mixed_tree): r for r in store.read().collect()}
    assert "x.tmp" not in rows and rows["d.docx"].content == "Report" and rows["a.zip/in.txt"].is_archived_file
    assert rows["data.csv"].pii_types == ["EMAIL_ADDRESS"]
    version = store.current_version()
    (mixed_tree / "late.txt").write_text("late")
    ingest(*where).awaitTermination()
    assert store.current_version() == version + 1 and store.read().count() == len(rows) + 1
    ingest(*where).awaitTermination()
    assert store.current_version() == version + 1


def test_index_store_versions(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "store"))
    os.makedirs(tmp_path / "store" / "index" / "v00000007.full")
    assert store.current_version() == 0 and store.read().count() == 0


def test_index_store_batches_and_snapshots(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "store"), max_batches=3)

    def rows(**contents):
        df = spark.createDataFrame([(p, p, 1, 1.0, "h", c, False) for p, c in contents.items()], "path string, filename string, size_bytes long, mtime double, crypto_hash string, content string, is_archived_file boolean")
        return pipeline.to_metadata(df)

    def contents(version=None):
        return {r.path: r.content for r in store.read(version).collect()}

    assert store.patch(rows(a="x"), ["content"]) == 0
    assert store.replace(rows(a="1", b="1")) == 1
    assert store.replace(rows(b="2", c="2")) == 2
    assert store.patch(rows(c="3", z="3").withColumn("content", F.nullif("content", F.lit("3"))), ["content"]) == 3
    assert [k for _, k, _ in store.versions()] == ["full", "replace", "patch"]
    assert contents() == {"a": "1", "b": "2", "c": None} and contents(2)["c"] == "2"
    assert store.replace(rows(a="4")) == 4
    assert [k for _, k, _ in store.versions()] == ["full", "replace", "patch", "replace", "full"]
    assert contents() == contents(4) == {"a": "4", "b": "2", "c": None}


def test_scan_faults_stay_mended(spark, mixed_tree, tmp_path, monkeypatch):
    """Repeated member names, files without an extractor, images in hidden folders, hashes kept by ingest."""
    with tarfile.open(mixed_tree / "twice.tar", "w") as archive:
        for name, text in (("note.txt", b"old"), ("./note.txt", b"new")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            archive.addfile(info, io.BytesIO(text))
    for folder in (".hid", "_und"):
        (mixed_tree / folder).mkdir()
        (mixed_tree / folder / "i.png").write_bytes((mixed_tree / "p.png").read_bytes())
    monkeypatch.setattr(pipeline, "FOLDERS_PER_READ", 2)
    store = IndexStore(spark, str(tmp_path / "store"))
    pipeline.scan(store, [str(mixed_tree)], ScanOptions(extractors={}))

    def rows():
        return {os.path.relpath(r.path, mixed_tree): r for r in store.read().collect()}

    first = rows()
    assert store.read().count() == len(first) and first["twice.tar/note.txt"].content == "new"
    assert first[".hid/i.png"].perceptual_hash and first["_und/i.png"].perceptual_hash
    assert not first["d.docx"].text_extracted
    pipeline.refine_text(store)
    assert rows()["d.docx"].content == "Report"
    os.utime(mixed_tree / "p.png", (2_000_000_000, 2_000_000_000))
    ingest(store, str(mixed_tree), str(tmp_path / "checkpoint")).awaitTermination()
    assert rows()["p.png"].mtime == 2_000_000_000 and rows()["p.png"].perceptual_hash == first["p.png"].perceptual_hash


def test_document_told_by_its_whole_directory(spark, tmp_path):
    """A document whose text lies behind many bytes of other entries is no archive."""
    late = zip_bytes({"docProps/thumb.bin": os.urandom(9000), "word/document.xml": zipfile.ZipFile(io.BytesIO(docx_bytes("late text"))).read("word/document.xml")})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "late.docx").write_bytes(late)
    (tmp_path / "in" / "broken.bin").write_bytes(late[:5000])
    store = IndexStore(spark, str(tmp_path / "store"))
    pipeline.scan(store, [str(tmp_path / "in")])
    rows = {r.filename: r for r in store.read().where("not is_archived_file").collect()}
    assert rows["late.docx"].mime_type == DOCX and rows["late.docx"].content == "late text"
    assert rows["broken.bin"].mime_type == "application/zip"
    assert store.read().where("path like '%late.docx/%'").count() == 0
    # Ingest tells it in the same way.
    other = IndexStore(spark, str(tmp_path / "other"))
    ingest(other, str(tmp_path / "in"), str(tmp_path / "checkpoint")).awaitTermination()
    order = lambda index: sorted(index.drop("pii_types", "content_embedding").collect(), key=lambda r: r.path)
    assert order(other.read()) == order(store.read())


def test_ingest_is_a_scan(spark, mixed_tree, tmp_path):
    """Hidden names, image hashes and errors as in a scan; a repeated batch changes nothing."""
    (mixed_tree / ".hid").mkdir()
    (mixed_tree / ".hid" / "_p.png").write_bytes(png_bytes(picture(3)))
    scanned, streamed = (IndexStore(spark, str(tmp_path / n)) for n in ("scanned", "streamed"))
    wanted = {(r.stage, r.path) for r in pipeline.scan(scanned, [str(mixed_tree)]).collect()}
    seen = []
    ingest(streamed, [str(mixed_tree)], str(tmp_path / "c1"), on_errors=lambda e: seen.extend(e.collect())).awaitTermination()
    order = lambda index: sorted(index.collect(), key=lambda r: r.path)
    assert order(streamed.read()) == order(scanned.read()) and {(r.stage, r.path) for r in seen} == wanted
    assert streamed.read().where("filename = '_p.png' and perceptual_hash is not null").count() == 1
    version = streamed.current_version()
    ingest(streamed, str(mixed_tree), str(tmp_path / "c2")).awaitTermination()  # from the start again
    assert streamed.current_version() == version


def test_bad_roots_are_reported(spark, corpus_tree, tmp_path):
    store = IndexStore(spark, str(tmp_path / "store"))
    missing = str(tmp_path / "missing")
    errors = pipeline.scan(store, [str(corpus_tree), missing]).collect()
    assert [(e.stage, e.path, e.message) for e in errors] == [("listing", missing, "not a folder")]
    assert store.read().count() == 3


def test_scan_counts_listed_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.zip").write_bytes(zip_bytes({"x.txt": b"x", "y.txt": b"y"}))
    (tmp_path / "in" / "b.txt").write_text("b")
    store = IndexStore(spark, str(tmp_path / "store"))
    pipeline.scan(store, [str(tmp_path / "in")])
    assert store.read().count() == 4
    assert [r.files_scanned for r in reports.scan_history(store.scan_log()).collect()] == [2]


def test_errors_of_every_stage(spark, tmp_path):
    """What the text and image stages could not read is in the errors, without another pass."""
    root = tmp_path / "in"
    root.mkdir()
    (root / "bad.docx").write_bytes(zip_bytes({"[Content_Types].xml": "<Types/>", "word/document.xml": "<broken"}))
    (root / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\x00" * 50)
    (root / "good.txt").write_text("good")
    store = IndexStore(spark, str(tmp_path / "store"))
    errors = {(e.stage, os.path.basename(e.path)): e.message for e in pipeline.scan(store, [str(root)]).collect()}
    assert set(errors) == {("text", "bad.docx"), ("image", "bad.png")} and "ParseError" in errors["text", "bad.docx"]
    assert "stage_error" not in store.read().columns and store.read().count() == 3
    assert reports.error_rollup(pipeline.stage_errors(store, 1)).count() == 1
