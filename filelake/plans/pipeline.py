"""Scan and refine runs, assembled from the sources, functions and operators."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.functions.formats import identify_formats, with_format
from filelake.functions.images import image_hashes
from filelake.functions.media import MediaTables, media_json
from filelake.functions.paths import file_name, parent_dir, suffix
from filelake.functions.pii import is_scannable, pii_types
from filelake.functions.text import EXTRACTORS, MAX_TEXT_BYTES, Extractor, extract, is_extractable
from filelake.functions.vectors import embed_text, with_embedding
from filelake.operators.incremental import (
    changed_files,
    formats_to_refine_under,
    images_to_refine_under,
    text_to_refine,
    text_to_refine_under,
)
from filelake.operators.rules import DEFAULT_EXCLUDE_DIRS, drop_junk
from filelake.operators.upsert import update_formats
from filelake.schemas import FILE_METADATA
from filelake.session import cut_lineage
from filelake.sources.archives import UNEXPANDED_EXTENSIONS, expand_archives, is_expandable, last_entries, materialise, scratch_folder
from filelake.sources.files import MEMBER
from filelake.sources.index_store import STAGE_ERROR, IndexStore
from filelake.sources.listing import walk
from filelake.sources.probe import present_files, probe_files, text_chunks, with_bytes

# Folders named to the image source in one read; extensions are named up to their number.
FOLDERS_PER_READ = 1000
MAX_EXTENSIONS = 200


@dataclass(frozen=True)
class ScanOptions:
    """What changes the result of a scan. An unused stage adds nothing to the plan."""

    exclude: Sequence[str] = ()
    use_default_excludes: bool = True
    pii_languages: Sequence[str] = ("en",)
    identify_formats: bool = False
    extract_text: bool = True
    perceptual_hash: bool = True
    unexpanded_extensions: Sequence[str] = tuple(UNEXPANDED_EXTENSIONS)
    extractors: dict[str, Extractor] = field(default_factory=lambda: dict(EXTRACTORS))
    # A fitted Spark ML encoder, or what makes a Python one (for neural models); by default word counts.
    encoder: PipelineModel | None = None
    make_encoder: Callable | None = None
    # Larger files are not given to an extractor; their raw text is scanned for personal data.
    max_text_bytes: int = MAX_TEXT_BYTES
    # Container and tag tables of media files, which fill ``exif_data``.
    media: MediaTables = MediaTables()

    @property
    def rules(self) -> list[str]:
        return sorted(set(self.exclude) | (set(DEFAULT_EXCLUDE_DIRS) if self.use_default_excludes else set()))

    @property
    def unexpanded(self) -> list[str]:
        defaults = [e.lower() for e in UNEXPANDED_EXTENSIONS]
        return sorted({*defaults, *(e.lower() for e in self.unexpanded_extensions)})


def with_text(files: DataFrame, options: ScanOptions) -> DataFrame:
    """Add text, embedding and personal-data types of files and archive members, read where they lie.

    A text file without an extractor, or too large for one, is scanned for personal data
    all the same, in chunks of its raw text.
    """
    mime = F.col("mime_type")
    text_type = F.coalesce(mime.startswith("text/"), F.lit(False))
    extractable = is_extractable(mime, F.col("size_bytes"), options.extractors, options.max_text_bytes)
    rows = with_bytes(files.drop("content", "head", "tail"), extractable)
    rows = rows.withColumn("__extract", extract(mime, F.col("content"), options.extractors, options.max_text_bytes))
    rows = rows.withColumn("__text", F.col("__extract.text"))
    if options.make_encoder:
        rows = rows.withColumn("content_embedding", embed_text(F.col("__text"), options.make_encoder))
    else:
        rows = with_embedding(rows, "__text", "content_embedding", options.encoder)
    rows = rows.withColumns(
        {
            "content_embedding": F.col("content_embedding").cast("array<float>"),
            "pii_types": pii_types(F.when(is_scannable(mime, F.col("__text")), F.col("__text")), options.pii_languages),
            # Files without an extractor stay untried, so that a later run with one takes them.
            "text_extracted": F.coalesce(extractable, F.lit(False)),
            "content": F.col("__text"),
            STAGE_ERROR: F.coalesce("read_error", "__extract.error"),
        }
    ).drop("__text", "__extract", "read_error")
    found = raw_text_pii(files.where(text_type & ~F.coalesce(extractable, F.lit(False))), options.pii_languages)
    rows = rows.join(found.withColumnRenamed("pii_types", "__raw_pii"), "path", "left")
    return rows.withColumn("pii_types", F.coalesce("pii_types", "__raw_pii")).drop("__raw_pii")


def raw_text_pii(files: DataFrame, languages: Sequence[str]) -> DataFrame:
    """``(path, pii_types)`` of files scanned chunk by chunk."""
    hits = text_chunks(files).select("path", F.explode(pii_types(F.col("chunk"), languages)).alias("kind"))
    # At most one entry per rule and file.
    return hits.groupBy("path").agg(F.array_sort(F.collect_set("kind")).alias("pii_types"))


def to_metadata(files: DataFrame, *more: str) -> DataFrame:
    """Bring derived rows into the index schema, with NULL for stages that did not run; ``more`` columns come along."""
    have = set(files.columns)
    return files.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(False) if f.name == "is_archived_file" else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in FILE_METADATA
        ],
        *more,
    )


def derive(typed: DataFrame, options: ScanOptions) -> DataFrame:
    """Index rows of typed files and archive members."""
    rows = typed.where("error is null").withColumn("is_archived_file", F.col("member").isNotNull())
    if options.identify_formats:
        rows = rows.withColumn("pronom_id", F.col("puid"))
    rows = with_text(rows, options) if options.extract_text else rows.withColumn(STAGE_ERROR, F.lit(None).cast("string"))
    return to_metadata(rows, STAGE_ERROR)


def archive_members(typed: DataFrame, options: ScanOptions) -> DataFrame:
    """Typed members of the archives among typed files, errors included."""
    containers = typed.where(is_expandable(F.col("mime_type"), F.col("ext"), options.unexpanded))
    return last_entries(expand_archives(containers.select("path", "crypto_hash"), options.unexpanded))


def copied_image_hashes(images: DataFrame) -> DataFrame:
    """Hashes of ``images (path, crypto_hash, ext, member)`` that the image source cannot reach.

    Members of archives and files with hidden names are copied to the shared folder, each
    distinct image once.
    """
    if images.isEmpty():
        return images.sparkSession.createDataFrame([], "path string, perceptual_hash string")
    spark, folder = images.sparkSession, scratch_folder(images, "images")
    name = lambda row: f"{row['crypto_hash']}.img"
    cut_lineage(materialise(images.dropDuplicates(["crypto_hash"]), folder, spark.sparkContext.defaultParallelism * 4, name))
    found = image_hashes(spark.read.format("image").option("dropInvalid", "true").load(folder))
    by_digest = found.select(F.regexp_extract("path", "([0-9a-f]{64})[.]img$", 1).alias("crypto_hash"), "perceptual_hash")
    return images.select("path", "crypto_hash").join(by_digest, "crypto_hash").drop("crypto_hash")


def image_hash_stage(needed: DataFrame) -> DataFrame:
    """Hashes of the images among ``(path, mtime, crypto_hash[, member])`` rows, decoded by the image source.

    The source reads whole folders, so what it reads is narrowed to what the rows need: their
    folders, extensions and times. Each of these only leaves out files that no row asks for.
    Folders are named to it some at a time, and what was found is written before the next, so
    the driver never holds more than one round's names, however many folders there are.
    """
    spark = needed.sparkSession
    if "member" not in needed.columns:
        needed = needed.withColumn("member", F.lit(None).cast(MEMBER))
    name = file_name(F.col("path"))
    shaped = needed.withColumns({"parent": parent_dir(F.col("path")), "ext": suffix(name), "hidden": name.rlike("^[._]")})
    reachable = cut_lineage(shaped.where("member is null and not hidden").select("path", "parent", "ext", "mtime"))
    copied = copied_image_hashes(shaped.where("member is not null or hidden").select("path", "crypto_hash", "ext", "member"))
    count, oldest = reachable.agg(F.count_distinct("parent"), F.min("mtime")).first()
    if not count:
        return copied
    reader = spark.read.format("image").option("dropInvalid", "true")
    extensions = [r["ext"] for r in reachable.select("ext").distinct().limit(MAX_EXTENSIONS + 1).collect()]
    if len(extensions) <= MAX_EXTENSIONS and all(e[1:].isalnum() for e in extensions):
        reader = reader.option("pathGlobFilter", "*{" + ",".join(sorted(extensions)) + "}")
    since = datetime.fromtimestamp(math.floor(oldest) - 1, timezone.utc)
    reader = reader.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", "UTC")
    rounds = -(-count // FOLDERS_PER_READ)
    turn = F.pmod(F.xxhash64("parent"), F.lit(rounds))
    out = scratch_folder(needed, "hashes")
    for k in range(rounds):
        folders = [r["parent"] or "/" for r in reachable.where(turn == k).select("parent").distinct().collect()]
        if folders:
            # Named folders show every file but hidden ones.
            found = image_hashes(reader.load(sorted(re.sub(r"([\\*?\[\]{}])", r"\\\1", folder) for folder in folders)))
            reachable.where(turn == k).select("path").join(found, "path").write.mode("append").parquet(out)
    return copied.unionByName(spark.read.schema(copied.schema).parquet(out))


def build_rows(listing: DataFrame, options: ScanOptions) -> tuple[DataFrame, DataFrame]:
    """``(rows, errors)`` for listed files, archive members included."""
    # Types are found once, before the rows are kept; the bytes they come from are not kept.
    probed = cut_lineage(with_format(probe_files(drop_junk(listing))).drop("head", "tail"))
    files = probed.withColumn("member", F.lit(None).cast(MEMBER))
    members = cut_lineage(archive_members(probed.where("error is null"), options))
    typed = files.unionByName(drop_junk(members.where("error is null")))
    rows = derive(typed, options)
    faults = [("probe", probed), ("archive", members)]
    if options.perceptual_hash:
        images = typed.where("error is null").where(F.col("mime_type").startswith("image"))
        hashes = image_hash_stage(images.select("path", "mtime", "crypto_hash", "member"))
        undecoded = images.select("path").join(hashes.where("perceptual_hash is not null"), "path", "left_anti")
        faults.append(("image", undecoded.withColumn("error", F.lit("the image could not be decoded"))))
        rows = rows.drop("perceptual_hash").join(hashes, "path", "left").select(*rows.columns)
    facts = media_json(options.media)
    if facts is not None:
        rows = rows.drop("exif_data").join(facts, "path", "left").select(*rows.columns)
    now = F.current_timestamp()
    parts = [
        df.where("error is not null").select(now.alias("ts"), F.lit(stage).alias("stage"), "path", F.col("error").alias("message"))
        for stage, df in faults
    ]
    return rows, reduce(DataFrame.unionByName, parts)


def stage_errors(store: IndexStore, version: int) -> DataFrame:
    """What went wrong in the text stage of the rows written as ``version``; found in the pass that wrote them."""
    failed = store.batch(version).where(F.col(STAGE_ERROR).isNotNull())
    return failed.select(F.current_timestamp().alias("ts"), F.lit("text").alias("stage"), "path", F.col(STAGE_ERROR).alias("message"))


def scan(store: IndexStore, roots: Sequence[str], options: ScanOptions | None = None, incremental: bool = True) -> DataFrame:
    """Index the files below the roots and return the errors of the run.

    Only new and changed files are read, unless ``incremental`` is off. The run is logged
    when it starts and when it ends, also when it fails.
    """
    options = options or ScanOptions()
    spark = store.spark
    scan_id, start = uuid.uuid4().hex, datetime.now(timezone.utc)
    store.log(scan_id=scan_id, event_time=start, start_time=start, root_paths=list(roots), files_scanned=0, status="started")
    status, count = "failed", 0
    try:
        listing, unlisted = walk(spark, roots, options.rules)
        if incremental:
            listing = cut_lineage(changed_files(listing, store.read()))
        rows, errors = build_rows(listing, options)
        errors = errors.unionByName(
            unlisted.select(F.current_timestamp().alias("ts"), F.lit("listing").alias("stage"), "path", F.col("error").alias("message"))
        )
        # The log counts the files taken from the listing, not what archives held.
        count = listing.count()
        if count:
            errors = errors.unionByName(stage_errors(store, store.replace(rows)))
        status = "completed"
        return errors
    finally:
        end = datetime.now(timezone.utc)
        store.log(
            scan_id=scan_id, event_time=end, start_time=start, end_time=end, root_paths=list(roots),
            files_scanned=count, status=status,
        )


def refine_text(store: IndexStore, prefixes: Sequence[str] | None = None, options: ScanOptions | None = None) -> int:
    """Extract text where it is missing; other columns are left as they are."""
    options = options or ScanOptions()
    index = store.read()
    chosen = text_to_refine_under(index, prefixes) if prefixes else text_to_refine(index)
    files = present_files(chosen.where(~F.col("is_archived_file")).select("path", "mime_type", "size_bytes"))
    rows = with_text(files, options)
    owned = ["content", "content_embedding", "pii_types", "text_extracted"]
    return store.patch(rows.select("path", *owned), owned)


def refine_images(store: IndexStore, prefixes: Sequence[str], mime_types: Sequence[str] | None = None) -> int:
    """Hash images below the given folders that have no hash yet."""
    chosen = images_to_refine_under(store.read(), prefixes, mime_types).where(~F.col("is_archived_file"))
    return store.patch(image_hash_stage(cut_lineage(chosen.select("path", "mtime", "crypto_hash"))), ["perceptual_hash"])


def refine_formats(store: IndexStore, prefixes: Sequence[str] | None = None) -> int:
    """Identify formats of indexed files again."""
    index = store.read()
    chosen = formats_to_refine_under(index, prefixes) if prefixes else index
    files = chosen.where(~F.col("is_archived_file")).select(
        "path", "filename", suffix(F.col("filename")).alias("ext"), parent_dir(F.col("path")).alias("parent"),
        "size_bytes", "mtime",
    )
    # Files that are gone drop out while they are probed.
    hits = cut_lineage(identify_formats(probe_files(files).where("error is null")))
    changed = update_formats(index.join(hits.select("path"), "path", "left_semi"), hits)
    return store.patch(changed, ["pronom_id", "mime_type"])
