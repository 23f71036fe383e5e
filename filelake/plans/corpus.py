"""Views of a set of plain tables as a file corpus.

They let every operator run over tables alone: documents and web pages are text files,
embeddings stand for images and text vectors, and events for tracks, tags, scans and
errors. Each view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.functions.media import AUDIO_TAGS
from filelake.functions.text import is_extractable


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_path() -> Column:
    return F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _file_rows(rows: DataFrame, path: Column, name: Column, mtime: Column, mime: str, text: str, puid: Column) -> DataFrame:
    return rows.select(
        path.alias("path"),
        name.alias("filename"),
        F.octet_length(text).cast("long").alias("size_bytes"),
        mtime.cast("double").alias("mtime"),
        F.sha2(F.col(text).cast("binary"), 256).alias("crypto_hash"),
        F.lit(mime).alias("mime_type"),
        F.col(text).alias("content"),
        puid.alias("pronom_id"),
        F.lit(None).cast("string").alias("perceptual_hash"),
    )


def documents_as_files(spark: SparkSession, folder: str) -> DataFrame:
    puid = F.when(F.col("lang") == "en", "x-fmt/111").when(F.col("lang") == "fr", "x-fmt/282")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = table(spark, folder, "documents")
    return _file_rows(docs, document_path(), name, F.col("doc_id"), "text/plain", "text", puid)


def pages_as_files(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.col("page_id").cast("string"), F.lit(".html"))
    path = F.concat(F.lit("/pages/"), name)
    mtime = F.col("page_id") + F.lit(1_000_000)
    return _file_rows(table(spark, folder, "pages"), path, name, mtime, "text/html", "html", F.lit("fmt/471"))


def file_index(spark: SparkSession, folder: str) -> DataFrame:
    return documents_as_files(spark, folder).unionByName(pages_as_files(spark, folder))


def labelled_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that were judged: ``path, quality, toxic``."""
    docs = table(spark, folder, "documents").select("doc_id", document_path().alias("path"))
    return docs.join(table(spark, folder, "labels"), "doc_id").select("path", "quality", "toxic")


def old_index(spark: SparkSession, folder: str) -> DataFrame:
    """An earlier index: only judged documents, the good ones since modified."""
    marks = labelled_paths(spark, folder)
    docs = documents_as_files(spark, folder).join(marks, "path")
    return docs.withColumn("mtime", F.col("mtime") - F.col("quality")).drop("quality", "toxic")


def pending_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with the text of judged documents still to be extracted, and images to be hashed."""
    marks = labelled_paths(spark, folder).select("path", F.lit(True).alias("marked"))
    files = file_index(spark, folder).join(marks, "path", "left")
    files = files.withColumn("content", F.when(F.col("marked").isNull(), F.col("content"))).drop("marked")
    return files.unionByName(pending_images(spark, folder), allowMissingColumns=True)


def tried_index(spark: SparkSession, folder: str) -> DataFrame:
    """Judged documents without text after a run; the toxic ones have a type that had no extractor."""
    docs = documents_as_files(spark, folder).join(labelled_paths(spark, folder), "path")
    docs = docs.withColumn("mime_type", F.when(F.col("toxic") == 1, "application/pdf").otherwise(F.col("mime_type")))
    tried = F.coalesce(is_extractable(F.col("mime_type"), F.col("size_bytes")), F.lit(False))
    return docs.withColumn("content", F.lit(None).cast("string")).withColumn("text_extracted", tried)


def sign_hash() -> Column:
    """16 hex digits of the sign bits of a vector of 64 numbers, the first one on top."""
    bits = F.transform("embedding", lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0")))
    return F.lower(F.lpad(F.conv(F.array_join(bits, ""), 2, 16), 16, "0"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat(F.lit("/img/"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".png"))
    return table(spark, folder, "embeddings").select(
        "vec_id", path.alias("path"), F.lit("image/png").alias("mime_type"), sign_hash().alias("perceptual_hash"), "embedding"
    )


def images_with_copies(spark: SparkSession, folder: str) -> DataFrame:
    """All images, and once more those whose number is also that of a judged document."""
    rows = images(spark, folder)
    marks = table(spark, folder, "labels").select(F.col("doc_id").alias("vec_id"))
    copies = rows.join(marks, "vec_id", "left_semi").withColumn("path", F.replace("path", F.lit("/img/"), F.lit("/img/copy/")))
    return rows.unionByName(copies).select("path", "mime_type", "perceptual_hash")


def images_with_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Images and copies, and once more the copied ones with three neighbouring bits of the hash turned."""
    rows = images(spark, folder)
    marks = table(spark, folder, "labels").select(F.col("doc_id").alias("vec_id"))
    first = F.pmod(F.col("vec_id"), F.lit(62))
    turned = F.transform("embedding", lambda x, i: ((x > 0) != ((i >= first) & (i < first + 3))).cast("double"))
    near = rows.join(marks, "vec_id", "left_semi").withColumn("embedding", turned)
    path = F.replace("path", F.lit("/img/"), F.lit("/img/near/"))
    near = near.select(path.alias("path"), "mime_type", sign_hash().alias("perceptual_hash"))
    return images_with_copies(spark, folder).unionByName(near)


def pending_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of which those with a negative first component have no hash yet."""
    rows = images(spark, folder)
    known = F.when(F.element_at("embedding", 1) >= 0, F.col("perceptual_hash"))
    return rows.select("path", "mime_type", known.alias("perceptual_hash"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat(F.lit("/vec/"), F.col("vec_id").cast("string"))
    return table(spark, folder, "embeddings").select("vec_id", path.alias("path"), F.col("embedding").alias("content_embedding"))


def format_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Format results for judged documents, and for images that are not in the index."""
    mime = F.when(F.col("toxic") == 1, "application/octet-stream").when(F.col("quality") == 1, "text/markdown").otherwise("")
    puid = F.when(F.col("quality") + F.col("toxic") > 0, "fmt/1149").otherwise("")
    known = labelled_paths(spark, folder).select("path", puid.alias("puid"), mime.alias("mime_type"))
    unknown = images(spark, folder).select("path", F.lit("fmt/11").alias("puid"), "mime_type")
    return known.unionByName(unknown)


def _events(spark: SparkSession, folder: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    return table(spark, folder, "events").withColumn("k", k)


def media_tracks(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "Video").when(F.col("event_type") == "click", "Audio").otherwise("General")
    return _events(spark, folder).select(
        F.concat(F.lit("/media/"), F.col("user_id").cast("string"), F.lit(".mp4")).alias("path"),
        F.col("event_id").alias("track_no"),
        kind.alias("track_type"),
        (F.col("k") * 16).alias("width"),
        (F.col("k") * 9).alias("height"),
        (F.col("event_id") * 10).alias("duration_ms"),
        F.col("value").alias("frame_rate"),
        F.concat(F.lit("codec-"), F.col("k").cast("string")).alias("codec"),
        F.concat(F.lit("format-"), F.col("k").cast("string")).alias("format"),
    )


def exif_tags(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select(
        F.concat(F.lit("/photo/"), F.col("user_id").cast("string"), F.lit(".jpg")).alias("path"),
        (F.col("k") + 256).alias("tag_id"),
        F.col("event_id").cast("string").alias("value"),
        F.col("event_id").alias("seq"),
    )


def audio_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is a tag of its user's recording; numbers that end in 0 have no value."""
    names = F.array(*[F.lit(n) for n in AUDIO_TAGS])
    value = F.when(F.col("k") % 10 != 0, F.concat(F.lit("v"), F.col("k").cast("string")))
    return _events(spark, folder).select(
        F.concat(F.lit("/audio/"), F.col("user_id").cast("string"), F.lit(".mp3")).alias("path"),
        F.element_at(names, (F.col("k") % len(AUDIO_TAGS) + 1).cast("int")).alias("field"),
        value.alias("value"),
        F.col("event_id").alias("seq"),
    )


def root_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Top-level names below one root per user; some of them are marker names."""
    names = {"error": "Windows", "signup": "pagefile.sys", "view": "Library", "click": "home", "purchase": "srv"}
    name = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in names.items()])
    return _events(spark, folder).select(
        F.concat(F.lit("/mnt/"), F.col("user_id").cast("string"), F.lit("-"), F.floor(F.col("k") / 4).cast("string")).alias("root"),
        name.alias("name"),
    )


def scan_log(spark: SparkSession, folder: str) -> DataFrame:
    """One scan per user and day; every event is a transition."""
    day = F.date_trunc("day", "ts")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("started")
    return _events(spark, folder).select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format(day, "yyyyMMdd")).alias("scan_id"),
        F.col("ts").alias("event_time"),
        day.alias("start_time"),
        F.when(status != "started", F.col("ts")).alias("end_time"),
        F.col("k").alias("files_scanned"),
        status.alias("status"),
    )


def errors(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat(F.lit("/data/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".bin"))
    message = F.concat(F.lit("Could not read '"), path, F.lit("': code "), F.floor(F.col("k") / 10).cast("string"))
    failed = _events(spark, folder).where("event_type = 'error'")
    return failed.select("ts", F.lit("probe").alias("stage"), path.alias("path"), message.alias("message"))


def turns_as_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn of a conversation as a newer state of one file; ``turn`` gives the order."""
    name = F.concat(F.col("conv_id").cast("string"), F.lit(".txt"))
    turns = table(spark, folder, "conversations")
    rows = _file_rows(
        turns.withColumn("__turn", F.col("turn")), F.concat(F.lit("/conv/"), name), name, F.col("turn"),
        "text/plain", "text", F.lit(None).cast("string"),
    )
    return rows


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Stars of orders around their customer, and chains of the turns of a conversation."""
    stars = table(spark, folder, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"),
    )
    name = F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("-"))
    chains = table(spark, folder, "conversations").where("turn > 0").select(
        F.concat(name, F.col("turn").cast("string")).alias("src"),
        F.concat(name, (F.col("turn") - 1).cast("string")).alias("dst"),
    )
    return stars.unionByName(chains)


def with_bytes(files: DataFrame) -> DataFrame:
    """Files in the form the format and text stages take: bytes, first and last bytes, extension."""
    from filelake.functions.formats import HEAD_BYTES, TAIL_BYTES
    from filelake.functions.paths import suffix

    raw = F.col("content").cast("binary")
    return files.select(
        "path", "filename", suffix(F.col("filename")).alias("ext"), "size_bytes", "mime_type", raw.alias("content"),
        F.substring(raw, 1, HEAD_BYTES).alias("head"), F.substring(raw, -TAIL_BYTES, TAIL_BYTES).alias("tail"),
    )
