"""Rules, incremental filters, upserts, formats and reports on small tables."""

import hashlib

import pytest
from conftest import plan_of
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from filelake.functions import formats, media, paths, pii, vectors
from filelake.operators import incremental, rules, upsert
from filelake.plans import reports

INDEX = "path string, filename string, size_bytes long, mtime double, crypto_hash string, mime_type string, content string, pronom_id string, pii_types array<string>"


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("/a/1.txt", "1.txt", 10, 3.0, "h1", "text/plain", "one", "x-fmt/111", None),
        ("/a/2.txt", "2.txt", 10, 1.0, "h1", "text/plain", None, None, []),
        ("/a/b/3.html", "3.html", 30, 2.0, "h2", "text/html", None, None, ["URL", "US_SSN"]),
        ("/ab/4.bin", "4.bin", 40, 2.0, "h3", None, None, "fmt/1", None),
    ]
    return spark.createDataFrame(rows, INDEX)


def column(df, name="path"):
    return [r[name] for r in df.collect()]


def test_format_bytes(spark):
    sizes = [100, 1024, 1536, 1152, 1023, 3 * 1024**2, 5 * 1024**3, 7 * 1024**4, 2 * 1024**5, None]
    want = ["100.00 B", "1.00 KB", "1.50 KB", "1.12 KB", "1023.00 B", "3.00 MB", "5.00 GB", "7.00 TB", "2048.00 TB", "0 B"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s long")
    assert column(df.orderBy("i").select(paths.format_bytes(F.col("s")).alias("t")), "t") == want


@pytest.mark.parametrize(
    "name, ext", [("a.txt", ".txt"), ("a.tar.gz", ".gz"), (".bashrc", ""), (".x.conf", ".conf"), ("plain", ""), ("A.LOG", ".LOG")]
)
def test_suffix(spark, name, ext):
    df = spark.createDataFrame([(name,)], "n string")
    assert column(df.select(paths.suffix(F.col("n")).alias("e")), "e") == [ext]


def test_prefixes_take_whole_components(spark, index):
    assert set(column(index.where(paths.under_any(F.col("path"), ["/a"])))) == {"/a/1.txt", "/a/2.txt", "/a/b/3.html"}
    assert index.where(paths.under_any(F.col("path"), ["/"])).count() == 4
    assert column(index.where(paths.under_any(F.col("path"), ["/a/1.txt"]))) == ["/a/1.txt"]


def test_exclusions(spark):
    listed = ["/r/a.txt", "/r/.git/x", "/r/src/p.egg-info/y", "/r/src/keep.txt", "/r/deep/node_modules/m/z", "/other/q"]
    df = spark.createDataFrame([(p,) for p in listed], "path string")
    kept = column(rules.exclude_paths(df, [*rules.DEFAULT_EXCLUDE_DIRS, "/other"]))
    assert kept == ["/r/a.txt", "/r/src/keep.txt"]
    assert len(column(rules.exclude_paths(df, ["SRC"]))) == 6
    assert "/r/src/keep.txt" not in column(rules.exclude_paths(df, ["SRC"], case_sensitive=False))
    assert column(rules.exclude_paths(df.where("path like '%.txt'"), ["[!a].txt", "?eep*"])) == ["/r/a.txt"]
    rooted = df.withColumn("root", F.lit("/r/src"))
    assert "/r/src/keep.txt" in column(rules.exclude_paths(rooted.where("path like '/r/src/%'"), ["src"], root="root"))


def test_default_rules(spark):
    entries = [("/w", "Windows"), ("/w", "Library"), ("/m", "System"), ("/l", "home")]
    got = {(r.root, r.platform, r.rule) for r in rules.default_rules(spark.createDataFrame(entries, "root string, name string")).collect()}
    assert ("/w", "windows", "/w/pagefile.sys") in got and ("/m", "macos", "/m/Users/*/Library") in got
    assert {r[0] for r in got} == {"/w", "/m"} and len(got) == 20


def test_junk(spark):
    df = spark.createDataFrame([(p,) for p in ["/a/.DS_Store", "/a/Thumbs.db", "/a/x.TMP", "/a/b.log", "/a/log"]], "path string")
    assert column(rules.drop_junk(df)) == ["/a/log"]


def test_changed_files(spark, index):
    listing = spark.createDataFrame([("/a/1.txt", 3.0), ("/a/2.txt", 1.5), ("/new", 0.0)], "path string, mtime double")
    assert set(column(incremental.changed_files(listing, index))) == {"/a/2.txt", "/new"}


def test_refine_selection_and_counts(spark, index):
    assert set(column(incremental.text_to_refine(index))) == {"/a/2.txt", "/a/b/3.html"}
    tried = index.withColumn("text_extracted", F.col("path") == "/a/2.txt")
    assert column(incremental.text_to_refine(tried)) == ["/a/b/3.html"]
    assert set(column(incremental.text_to_refine_under(index, ["/a/b", "/ab"]))) == {"/a/b/3.html", "/ab/4.bin"}
    images = index.withColumn("perceptual_hash", F.lit(None).cast("string")).withColumn("mime_type", F.lit("image/png"))
    assert incremental.images_to_refine_under(images, ["/a"]).count() == 3
    assert incremental.images_to_refine_under(images, ["/a"], ["image/gif"]).count() == 0
    counts = incremental.pending_counts(index.withColumn("perceptual_hash", F.lit(None).cast("string"))).first()
    assert (counts.files, counts.text_pending, counts.image_pending, counts.format_pending) == (4, 2, 0, 2)
    assert column(incremental.existing_only(index, index.where("mtime > 2"))) == ["/a/1.txt"]


def test_upserts_are_idempotent(spark, index):
    batch = index.where("path = '/a/1.txt'").withColumn("content", F.lit("new")).unionByName(
        index.where("path = '/a/2.txt'").withColumn("path", F.lit("/new"))
    )
    once = upsert.upsert_replace(index, batch)
    twice = upsert.upsert_replace(once, batch)
    key = lambda df: sorted(map(str, df.collect()))
    assert once.count() == 5 and key(once) == key(twice)
    assert incremental.changed_files(batch.select("path", "mtime"), once).count() == 0
    patched = upsert.upsert_patch(index, batch, ["content"])
    assert patched.columns == index.columns and patched.count() == 4
    rows = {r.path: r for r in patched.collect()}
    assert rows["/a/1.txt"].content == "new" and rows["/a/1.txt"].pronom_id == "x-fmt/111"


def test_patch_may_set_null(spark, index):
    gone = index.where("path = '/a/1.txt'").select("path", F.lit(None).cast("string").alias("content"))
    assert upsert.upsert_patch(index, gone, ["content"]).where("path = '/a/1.txt'").first().content is None


def test_latest_per_path(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 5, "y")], "path string, seq int, v string")
    assert {tuple(r) for r in upsert.latest_per_path(df, "seq").collect()} == {("a", None), ("b", "y")}


def test_update_formats(spark, index):
    hits = [("/a/1.txt", "fmt/9", "text/markdown"), ("/a/2.txt", "fmt/8", ""), ("/ab/4.bin", "fmt/7", "application/octet-stream"), ("/no", "fmt/1", "x/y"), ("/a/b/3.html", "", "x/y")]
    out = upsert.update_formats(index, spark.createDataFrame(hits, "path string, puid string, mime_type string"))
    got = {r.path: (r.pronom_id, r.mime_type) for r in out.collect()}
    assert got == {
        "/a/1.txt": ("fmt/9", "text/markdown"),
        "/a/2.txt": ("fmt/8", "text/plain"),
        "/a/b/3.html": (None, "text/html"),
        "/ab/4.bin": ("fmt/7", None),
    }


def test_reports(spark, index):
    dupes = reports.find_dupes(index).collect()
    assert [(r.role, r.path, r.set_size) for r in dupes] == [("Source", "/a/2.txt", 2), ("Dup", "/a/1.txt", 2)]
    assert column(reports.lonely_files(index)) == ["/ab/4.bin", "/a/b/3.html"]
    assert reports.lonely_files_count(index).first()[0] == 2
    assert column(reports.largest_files(index, 2)) == ["/ab/4.bin", "/a/b/3.html"]
    assert [tuple(r) for r in reports.type_summary(index).collect()] == [("text/plain", 2, 20), (None, 1, 40), ("text/html", 1, 30)]
    assert [tuple(r) for r in reports.pronom_summary(index).collect()] == [("fmt/1", 1, 40), ("x-fmt/111", 1, 10)]
    assert [tuple(r) for r in reports.list_pii_files(index).collect()] == [("/a/b/3.html", "URL, US_SSN")]


def test_duplicates_and_unique_files_make_up_the_index(spark, index):
    lonely = reports.lonely_files(index, 1000)
    assert set(column(reports.find_dupes(index))) | set(column(lonely)) == set(column(index))


def test_report_plans(spark, index, tmp_path):
    index.write.parquet(str(tmp_path / "i"))
    stored = spark.read.parquet(str(tmp_path / "i"))
    for report in (reports.find_dupes, reports.lonely_files, reports.largest_files, reports.type_summary):
        assert "content" not in plan_of(report(stored))
    for report in (reports.lonely_files, reports.largest_files):
        assert "TakeOrderedAndProject" in plan_of(report(stored))


def test_error_rollup_keeps_five_of_a_kind(spark):
    rows = [(i, f"Cannot open '/data/{i}/x.bin': denied") for i in range(12)] + [(50, "C:\\temp\\a broke")]
    df = spark.createDataFrame(rows, "n int, message string").select(
        F.timestamp_seconds("n").alias("ts"), F.lit("probe").alias("stage"), F.col("n").cast("string").alias("path"), "message"
    )
    rolled = reports.error_rollup(df)
    assert "WindowGroupLimit" in plan_of(rolled)
    got = rolled.orderBy("kind", "occurrence").collect()
    assert [(r.kind, r.occurrence, r.suppressed) for r in got] == [("<PATH> broke", 1, 0)] + [
        ("Cannot open <PATH>: denied", i, 7) for i in range(1, 6)
    ]
    assert got[1].message == "Cannot open '/data/0/x.bin': denied"


def test_scan_history(spark):
    df = spark.sql(
        "select * from values ('s1', timestamp'2024-01-01 10:00:00', timestamp'2024-01-01 10:00:00', null, 0L, 'started'),"
        "('s1', timestamp'2024-01-01 11:00:00', timestamp'2024-01-01 10:00:00', timestamp'2024-01-01 11:00:00', 7L, 'completed'),"
        "('s2', timestamp'2024-01-02 10:00:00', timestamp'2024-01-02 10:00:00', null, 0L, 'started')"
        " as t(scan_id, event_time, start_time, end_time, files_scanned, status)"
    )
    assert [tuple(r) for r in reports.scan_history(df).collect()] == [
        ("s2", "STARTED", "2024-01-02 10:00:00", "In Progress", 0),
        ("s1", "COMPLETED", "2024-01-01 10:00:00", "2024-01-01 11:00:00", 7),
    ]


@pytest.mark.parametrize(
    "text, languages, types",
    [
        ("mail me: jo@example.org", ["en"], ["EMAIL_ADDRESS"]),
        ("card 4111 1111 1111 1111 and 10.0.0.1", ["en"], ["CREDIT_CARD", "IP_ADDRESS"]),
        ("card 4111 1111 1111 1112", ["en"], None),
        ("id 123-45-6789", ["en"], ["US_SSN"]),
        ("id 123-45-6789", ["fr"], None),
        ("id 12345678Z", ["en", "es"], ["ES_NIF"]),
        ("call (555) 123-4567 or https://example.org", ["en"], ["PHONE_NUMBER", "URL"]),
        ("This is the first file.", ["en"], None),
        ("cards 378282246310005", ["en"], ["CREDIT_CARD"]),
        ("cards 3782 822463 10005", ["en"], ["CREDIT_CARD"]),
        ("cards 3782 822463 10006", ["en"], None),
        ("at 2001:0db8:0000:0000:0000:ff00:0042:8329", ["en"], ["IP_ADDRESS"]),
        ("at 2001:db8::ff00:42:8329 or std::vector", ["en"], ["IP_ADDRESS"]),
        ("std::vector at 10:20:30", ["en"], None),
        ("pay DE89370400440532013000", ["en"], ["IBAN_CODE"]),
        ("pay GB82 WEST 1234 5698 7654 32 now", ["en"], ["IBAN_CODE"]),
        ("pay DE88370400440532013000", ["en"], None),
    ],
)
def test_pii(spark, text, languages, types):
    df = spark.createDataFrame([(text,)], "t string").select(pii.pii_types(F.col("t"), languages).alias("p"))
    assert df.first().p == types


def test_search_by_text(spark):
    rows = [("a", "red apples and pears"), ("b", "blue sky"), ("c", "red apples and pears"), ("d", None), ("e", "red apples")]
    index = vectors.with_embedding(spark.createDataFrame(rows, "path string, content string"), "content", "content_embedding")
    found = [tuple(r) for r in reports.search_text(index, "Red Apples").collect()]
    assert found[0] == ("e", 1.0) and [f[0] for f in found[1:3]] == ["a", "c"] and "d" not in dict(found)
    with pytest.raises(ValueError):
        reports.search_text(index, " \n")


def test_audio_fields(spark):
    rows = [("a", "title", None, 1), ("a", "title", "T", 2), ("a", "title", "U", 3), ("a", "other", "x", 4), ("b", "genre", None, 1)]
    found = media.audio_metadata(spark.createDataFrame(rows, "path string, field string, value string, seq long"))
    assert [(r.path, r.title, r.genre) for r in found.collect()] == [("a", "T", None)]
    assert [r.exif_data for r in media.audio_json(found).collect()] == ['{"title":"T"}']


def test_pii_at_the_end_of_a_long_text(spark):
    df = spark.range(1).select(F.concat(F.repeat(F.lit("x "), 700_000), F.lit("a@b.io")).alias("t"))
    assert df.select(pii.pii_types(F.col("t")).alias("p")).first().p == ["EMAIL_ADDRESS"]


FILES = [
    (b"%PDF-1.7\n...", ".pdf", "application/pdf", "fmt/276"),
    (b"\x89PNG\r\n\x1a\n" + b"0" * 20, ".png", "image/png", "fmt/11"),
    (b"\xff\xd8\xff\xe0\x00\x10JFIF\x00", ".jpg", "image/jpeg", "fmt/43"),
    (b"\xff\xd8\xff\xdb", ".jpg", "image/jpeg", "fmt/41"),
    (b"RIFF\x01\x02\x03\x04WAVEfmt ", ".wav", "audio/x-wav", "fmt/6"),
    (b"\x00\x00\x00\x18ftypmp42", ".mp4", "video/mp4", "fmt/199"),
    (b"x" * 257 + b"ustar\x00", ".tar", "application/x-tar", "x-fmt/265"),
    (b"\x1f\x8b\x08\x00", ".gz", "application/gzip", "x-fmt/266"),
    (b"BZh91AY&SY", ".bz2", "application/x-bzip2", "x-fmt/268"),
    (b"PK\x03\x04" + b"\x00" * 26 + b"mimetypeapplication/vnd.oasis.opendocument.text", ".odt", "application/vnd.oasis.opendocument.text", "fmt/291"),
    (b"PK\x03\x04" + b"\x00" * 26 + b"[Content_Types].xml...word/document.xml", ".docx", formats._OOXML + "wordprocessingml.document", "fmt/412"),
    (b"PK\x03\x04" + b"\x00" * 40, ".zip", "application/zip", "x-fmt/263"),
    (b"\xef\xbb\xbf\n <!DOCTYPE html><html>", ".html", "text/html", "fmt/471"),
    (b"<HTML lang=en>", ".htm", "text/html", "fmt/96"),
    (b"From: a@b.c\nSubject: x\n\nhi", ".eml", "message/rfc822", "fmt/278"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", ".doc", "application/msword", "fmt/111"),
    (b"just text", ".md", "text/plain", None),
    (b"a,b\n1,2", ".csv", "text/csv", None),
    ("é".encode() * 3000, ".txt", "text/plain", None),
    (b"a" * 4095 + "é".encode(), ".txt", "text/plain", None),
    (b"\xff\xfe\x00\x01\x02", ".dat", "application/octet-stream", None),
    (b"ab\x00cd", "", "application/octet-stream", None),
    (b"", ".txt", "inode/x-empty", None),
]


def test_format_signatures(spark):
    rows = [(str(i), bytearray(f[0][:4096]), bytearray(f[0][-64:]), f[1]) for i, f in enumerate(FILES)]
    df = spark.createDataFrame(rows, "path string, head binary, tail binary, ext string")
    got = {int(r.path): (r.mime_type, r.puid) for r in formats.with_format(df).collect()}
    assert [got[i] for i in range(len(FILES))] == [f[2:] for f in FILES]
    found = {int(r.path): (r.mime_type, r.puid) for r in formats.identify_formats(df).collect()}
    assert set(found) == {i for i, f in enumerate(FILES) if f[3]}


def test_thousands_of_signatures(spark):
    """The plan does not grow with the table, and stays compiled."""
    table = [formats.Signature(f"x/{i}", f"t/{i}", ("BOF", "BOF", "EOF", "TEXT")[i % 4], 4 * (i % 4 == 1), 4 * (i % 4 == 1), f"{i:08X}AB" if i % 4 != 3 else f"<n{i}>") for i in range(5_000)]
    rows = [(str(i), bytearray(b), bytearray(b[-64:]), "") for i, b in enumerate([bytes.fromhex("000007D0ABFF"), b"zzzz" + bytes.fromhex("000007D1AB"), b"q" + bytes.fromhex("000007D2AB"), b" \n<N2003> x", b"", b"\x00"])]
    df = spark.createDataFrame(rows, "path string, head binary, tail binary, ext string")
    found = formats.identify_formats(df, table)
    assert {r.path: r.puid for r in found.collect()} == {"0": "t/2000", "1": "t/2001", "2": "t/2002", "3": "t/2003"}
    assert "*(2) Project" in plan_of(found)
    places = {formats._entry(i, s)[0] for i, s in enumerate(table)}
    assert len(places) == 4


def test_signature_at_the_end_and_in_a_window(spark):
    table = [formats.Signature("x/end", "t/1", "EOF", 0, 2, "454E44"), formats.Signature("x/window", "t/2", "BOF", 1, 3, "4142")]
    rows = [("a", b"..END!"), ("b", b"..END!!!"), ("c", b"..ABxxxx"), ("d", b"....ABxx")]
    df = spark.createDataFrame([(p, bytearray(b), bytearray(b)) for p, b in rows], "path string, head binary, tail binary")
    assert {r.path: r.puid for r in formats.identify_formats(df, table).collect()} == {"a": "t/1", "c": "t/2"}


def test_media_json(spark):
    tracks = spark.createDataFrame(
        [("v", 1, "General", None, None), ("v", 3, "Video", 20, "late"), ("v", 2, "Video", 10, "avc"), ("a", 1, "Audio", None, "aac")],
        "path string, track_no int, track_type string, width int, format string",
    )
    for name in ("height", "duration_ms", "frame_rate", "codec"):
        tracks = tracks.withColumn(name, F.lit(None).cast("int"))
    videos = media.video_metadata(tracks)
    assert [(r.path, r.width, r.format, r.audio_codec) for r in videos.collect()] == [("v", 10, "avc", None)]
    assert media.video_json(videos).first().exif_data == (
        '{"width":10,"height":null,"duration_ms":null,"frame_rate":null,"codec":null,"format":"avc","audio_codec":null}'
    )
    tags = spark.createDataFrame([("a", "Ann", None)], "path string, artist string, album string")
    for name in media.AUDIO_TAGS[2:]:
        tags = tags.withColumn(name, F.lit(None).cast("string"))
    assert media.audio_json(tags).first().exif_data == '{"artist":"Ann"}'


def test_exif_json(spark):
    df = spark.createDataFrame([("p", 271, "Old", 1), ("p", 271, "Make", 2), ("p", 9999, "x", 1)], "path string, tag_id int, value string, seq int")
    assert media.exif_json(media.exif_names(df)).first().exif_data == '{"9999":"x","Make":"Make"}'


def test_encoders_by_spark_ml(spark, tmp_path):
    """Word counts as unit vectors without Python workers; a fitted encoder survives saving."""
    rows = [(0, "One one two"), (1, ""), (2, None), (3, " \n "), (4, "one\tthree  three"), (5, "ONE")]
    df = spark.createDataFrame(rows, "id int, text string")
    encoded = vectors.with_embedding(df, "text", "v")
    assert "Python" not in plan_of(encoded) and encoded.columns == ["id", "text", "v"]
    got = {r.id: r.v for r in encoded.collect()}
    slot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % vectors.DIMENSIONS
    assert got[1] is None and got[2] is None and sum(got[3]) == 0 and got[5][slot("one")] == 1
    assert abs(got[0][slot("one")] - 2 / 5**0.5) < 1e-12 and abs(got[0][slot("two")] - 1 / 5**0.5) < 1e-12
    model = vectors.fit_encoder(df, "text")
    model.write().overwrite().save(f"{tmp_path}/model")
    loaded = PipelineModel.load(f"{tmp_path}/model")
    fitted, again = ({r.id: r.v for r in vectors.with_embedding(df, "text", "v", m).collect()} for m in (model, loaded))
    assert fitted == again and fitted[4][slot("three")] > fitted[4][slot("one")] > 0
    index = vectors.with_embedding(df.select(F.col("id").cast("string").alias("path"), "text"), "text", "content_embedding", loaded)
    assert reports.search_text(index, "three", 1, encoder=loaded).first()["path"] == "4"


def test_further_personal_data(spark):
    cases = [
        ("pay 3056 930902 5904 now", ["CREDIT_CARD"]), ("pay 3056 930902 5906 now", None),
        ("to bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", ["CRYPTO"]), ("to 1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", ["CRYPTO"]),
        ("to 1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN3", None), ("0x52908400098527886E0F7030069857D2E4169EE7", ["CRYPTO"]),
        ("itin 912-70-1234", ["US_ITIN", "US_SSN"]), ("nhs 943 476 5919", ["PHONE_NUMBER", "UK_NHS"]), ("nhs 943 476 5918", ["PHONE_NUMBER"]), ("nhs 9434765919", ["UK_NHS"]),
        ("Passport no. 123456789", ["US_PASSPORT"]), ("no. 123456789", None), ("Bank account: 12345678", ["US_BANK_NUMBER"]),
        ("Driver's license D1234567", ["US_DRIVER_LICENSE"]), ("nothing", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.k for r in df.select("i", pii.pii_types(F.col("t")).alias("k")).collect()}
    assert [got[i] for i in range(len(cases))] == [k for _, k in cases]


def test_media_tables_fill_exif_data(spark):
    tracks = spark.createDataFrame([("/v", 1, "Video", 640, 480, 10, 25.0, "avc", "mp4"), ("/a", 1, "Audio", None, None, 10, None, "aac", "aac")], "path string, track_no int, track_type string, width int, height int, duration_ms int, frame_rate double, codec string, format string")
    tags = spark.createDataFrame([("/a", "artist", "Jo", 1), ("/a", "title", None, 2)], "path string, field string, value string, seq int")
    exif = spark.createDataFrame([("/p", 271, "Maker", 1), ("/p", 99999, "x", 1)], "path string, tag_id int, value string, seq int")
    rows = media.media_json(media.MediaTables(tracks, tags, exif))
    got = {r.path: (r.w, r.artist, r.make, r.odd, r.none) for r in rows.select("path", media.exif_value(F.col("exif_data"), "width", "int").alias("w"), media.exif_value(F.col("exif_data"), "artist").alias("artist"), media.exif_value(F.col("exif_data"), "Make").alias("make"), media.exif_value(F.col("exif_data"), "99999").alias("odd"), media.exif_value(F.col("exif_data"), "no'ne").alias("none")).collect()}
    assert got == {"/v": (640, None, None, None, None), "/a": (None, "Jo", None, None, None), "/p": (None, None, "Maker", "x", None)}
    assert media.media_json(media.MediaTables()) is None


def test_rules_are_tried_only_on_texts_with_their_sign(spark):
    rules = [pii.PiiRule("A", "a+", sign="b"), pii.PiiRule("C", "c", sign="b"), pii.PiiRule("D", "d")]
    rows = spark.createDataFrame([("aaa",), ("ab",), ("bcd",), ("d",), (None,)], "text string")
    found = [r[0] for r in rows.select(pii.pii_types(rows.text, rules=rules)).collect()]
    assert found == [None, ["A"], ["C", "D"], ["D"], None]
    # One text per rule that hardly has its sign, and is found all the same.
    least = {
        "4111-1111-1111-1111": "CREDIT_CARD", "3782 822463 10005": "CREDIT_CARD", "0x" + "aB" * 20: "CRYPTO", "a@b.io": "EMAIL_ADDRESS",
        "bc1" + "q" * 30: "CRYPTO", "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2": "CRYPTO", "GB82WEST12345698765432": "IBAN_CODE", "1.2.3.4": "IP_ADDRESS",
        "a:b:c:d:e:f:a:b": "IP_ADDRESS", "fe::cd": "IP_ADDRESS", "(555) 123-4567": "PHONE_NUMBER", "http://a.io": "URL", "123-45-6789": "US_SSN",
        "943 476 5919": "UK_NHS", "12345678Z": "ES_NIF", "1 84 12 76 451 089 46": "FR_NIR", "Passport A12345678": "US_PASSPORT",
        "account 12345678": "US_BANK_NUMBER", "driver's license D1234": "US_DRIVER_LICENSE", "912-70-1234": "US_ITIN",
    }
    texts = spark.createDataFrame([(t,) for t in least], "text string")
    found = texts.select("text", pii.pii_types(texts.text, ["en", "es", "fr"])).collect()
    assert [t for t, kinds in found if least[t] not in (kinds or [])] == []
