"""Reports over the index. Each is one lazy plan that reads only the columns it shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelake.functions.vectors import cosine_to, with_embedding
from filelake.operators.components import connected_components
from filelake.operators.similarity import similar_images, similar_vectors
from filelake.operators.skew import with_group_stats

# Fixed value: what counts as a file path inside an error message.
PATH_IN_MESSAGE = r"""['"]?([a-zA-Z]:\\|/)[^:,'"\s]+['"]?"""


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once.

    A count per key, combined before the shuffle, tells them; only they pay for what follows.
    The join may be split where one key has very many rows.
    """
    keys = rows.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return rows.join(keys, F.col(key) == F.col("__key"), "left_semi")


def find_dupes(index: DataFrame) -> DataFrame:
    """Files whose content occurs more than once; the oldest of a set is its source.

    The closing sort is on all three keys, so one huge set is spread over many ranges.
    """
    files = repeated(index.select("crypto_hash", "mtime", "path", "size_bytes"), "crypto_hash")
    first = F.struct("mtime", "path")
    sets = with_group_stats(
        files, "crypto_hash", "path", F.col("set_size") > 1, count="set_size", minimum={"__source": first}
    )
    role = F.when(F.col("path") == F.col("__source.path"), "Source").otherwise("Dup")
    return sets.select("crypto_hash", "set_size", role.alias("role"), "path", "size_bytes", "mtime").orderBy(
        "crypto_hash", "mtime", "path"
    )


def _unique_files(index: DataFrame) -> DataFrame:
    """A file without duplicates is a group of one, so the group's minima are the file itself."""
    return (
        index.groupBy("crypto_hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min("size_bytes").alias("size_bytes"), F.min("path").alias("path"))
        .where("n = 1")
        .select("path", "size_bytes", "crypto_hash")
    )


def lonely_files(index: DataFrame, limit: int = 20) -> DataFrame:
    return _unique_files(index).orderBy(F.desc("size_bytes"), "path").limit(limit)


def lonely_files_count(index: DataFrame) -> DataFrame:
    counts = index.groupBy("crypto_hash").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n = 1").agg(F.count(F.lit(1)).alias("unique_files"))


def image_dupes_exact(index: DataFrame) -> DataFrame:
    """Images with the same perceptual hash, one row per file."""
    images = repeated(index.where("perceptual_hash is not null").select("perceptual_hash", "path"), "perceptual_hash")
    groups = with_group_stats(images, "perceptual_hash", "path", F.col("group_size") > 1, count="group_size")
    return groups.select("perceptual_hash", "group_size", "path").orderBy("perceptual_hash", "path")


def image_similar_groups(index: DataFrame, threshold: int = 0) -> DataFrame:
    """Groups of images connected by perceptual-hash distances of at most ``threshold``."""
    pairs = similar_images(index, threshold)
    return connected_components(pairs.select("src", "dst")).withColumnRenamed("node", "path")


def similar_text_groups(index: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Groups of files connected by embedding similarities of at least ``threshold``."""
    pairs = similar_vectors(index.select("path", F.col("content_embedding").alias("embedding")), threshold)
    return connected_components(pairs.select("src", "dst")).withColumnRenamed("node", "path")


def semantic_search(index: DataFrame, query: list[float], limit: int = 10) -> DataFrame:
    """Files most similar to a query vector; ties by path."""
    if not query:
        raise ValueError("the query is empty")
    scored = index.where("content_embedding is not null").select(
        "path", cosine_to(F.col("content_embedding"), query).alias("__score")
    )
    # Equal vectors tie, whatever the last bits of their sums.
    top = scored.orderBy(F.desc(F.round("__score", 12)), "path").limit(limit)
    return top.select("path", F.round("__score", 4).alias("score"))


def search_text(index: DataFrame, text: str, limit: int = 10, encoder: PipelineModel | None = None, make_encoder: Callable | None = None) -> DataFrame:
    """Files most similar to a text, which is encoded as the index was."""
    if not text.strip():
        raise ValueError("the query is empty")
    if make_encoder:
        return semantic_search(index, [float(x) for x in make_encoder()(text)], limit)
    asked = with_embedding(index.sparkSession.createDataFrame([(text,)], "text string"), "text", "v", encoder)
    return semantic_search(index, asked.first()["v"], limit)


def largest_files(index: DataFrame, limit: int = 20) -> DataFrame:
    return index.select("path", "size_bytes").orderBy(F.desc("size_bytes"), "path").limit(limit)


def _summary(index: DataFrame, key: str) -> DataFrame:
    totals = index.groupBy(key).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_bytes")
    )
    return totals.orderBy(F.desc("file_count"), key)


def type_summary(index: DataFrame) -> DataFrame:
    return _summary(index, "mime_type")


def pronom_summary(index: DataFrame) -> DataFrame:
    return _summary(index.where("pronom_id is not null"), "pronom_id")


def list_pii_files(index: DataFrame) -> DataFrame:
    found = index.where(F.size("pii_types") > 0)
    return found.select("path", F.array_join("pii_types", ", ").alias("pii_types")).orderBy("path")


def scan_states(log: DataFrame) -> DataFrame:
    """Current row of every scan: the log gets one row per transition and the last one counts."""
    columns = [c for c in log.columns if c not in ("scan_id", "event_time")]
    order = F.struct("event_time", F.col("status") != "started")
    last = log.groupBy("scan_id").agg(F.max_by(F.struct(*columns), order).alias("__last"))
    return last.select("scan_id", "__last.*")


def scan_history(log: DataFrame, limit: int = 50) -> DataFrame:
    pattern = "yyyy-MM-dd HH:mm:ss"
    top = scan_states(log).orderBy(F.desc("start_time"), "scan_id").limit(limit)
    return top.select(
        "scan_id",
        F.upper("status").alias("status"),
        F.date_format("start_time", pattern).alias("started"),
        F.coalesce(F.date_format("end_time", pattern), F.lit("In Progress")).alias("ended"),
        "files_scanned",
    )


def error_rollup(errors: DataFrame, keep: int = 5) -> DataFrame:
    """First ``keep`` messages of every kind, a kind being the message without its paths.

    The rank filter is applied on the map side first, and counts are combined there too,
    so a kind that makes up most of the log sends few rows.
    """
    keyed = errors.select("ts", "path", "message", F.regexp_replace("message", PATH_IN_MESSAGE, "<PATH>").alias("kind"))
    order = Window.partitionBy("kind").orderBy("ts", "path", "message")
    first = keyed.withColumn("occurrence", F.row_number().over(order)).where(F.col("occurrence") <= keep)
    totals = keyed.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    return first.join(totals, "kind").select(
        "kind",
        "occurrence",
        "ts",
        "message",
        F.greatest(F.col("total") - F.lit(keep), F.lit(0)).alias("suppressed"),
    )
