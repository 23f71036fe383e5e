"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from filelake.llm import hnsw, jaccard, langid, merkle, mixing, negatives, packing, pitman_yor, records, runs, suffix_dedup, surrogates, warc
from filelake.llm.common import prepare, table

TOKENIZER = "byte_bpe_50k.json"
SURROGATE_KEY = b"example key of the registered query"


def _docs(spark, d):
    return table(prepare(spark), d, "documents")


def op1_document_fingerprints(spark, d):
    return merkle.fingerprint_edits(_docs(spark, d))


def op2_suffix_dedup(spark, d):
    return suffix_dedup.remove_repeats(_docs(spark, d)).drop("kept")


def op3_pii_surrogates(spark, d):
    found = surrogates.replace_entities(_docs(spark, d).select("doc_id", "text"), SURROGATE_KEY)
    return found.select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))


def op4_language_id(spark, d):
    return langid.predict_languages(_docs(spark, d))


def op5_binary_records(spark, d):
    return records.write_and_read(_docs(spark, d), public_tokenizers.path(TOKENIZER))


def op6_warc_zstd(spark, d):
    return warc.archive_pages(table(prepare(spark), d, "pages"))


def op7_hnsw_near_dedup(spark, d):
    return hnsw.near_duplicates(table(prepare(spark), d, "embeddings"))


def op8_source_mixing(spark, d):
    mixed = mixing.mix_sources(_docs(spark, d))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_pattern_packing(spark, d):
    return packing.pack_documents(_docs(spark, d), public_tokenizers.path(TOKENIZER))


def op10_ngram_jaccard(spark, d):
    return jaccard.jaccard_components(_docs(spark, d))


def op11_pitman_yor(spark, d):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    scores = pitman_yor.score_documents(_docs(spark, d), ~held_out)
    return scores.withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def planted_period(doc_id, n):
    """Every tenth document repeats a stretch of its own words from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places < a, places, a + (places - a) % p)


def op12_periodic_runs(spark, d):
    found = runs.word_runs(_docs(spark, d), rewrite=planted_period)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("by"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.by")).alias("length"),
        F.col("top.period").alias("period"),
        F.expr("-1000 * top.by div top.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n")))).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark, d):
    rows = table(prepare(spark), d, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vec = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    points = rows.where(finite).select("vec_id", label.alias("label"), vec.alias("vec"))
    return negatives.mine_hard_negatives(points, F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_suffix_dedup,
        op3_pii_surrogates,
        op4_language_id,
        op5_binary_records,
        op6_warc_zstd,
        op7_hnsw_near_dedup,
        op8_source_mixing,
        op9_pattern_packing,
        op10_ngram_jaccard,
        op11_pitman_yor,
        op12_periodic_runs,
        op13_hard_negatives,
    )
}

ORACLE = {
    "op6_warc_zstd": """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        q AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM q)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM g""",
    "op13_hard_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
               CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
            FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
            AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5""",
}
