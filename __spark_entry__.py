
from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.functions import formats, media, paths, pii, text, vectors
from filelake.operators import components, incremental, rules, similarity, upsert
from filelake.operators.skew import spread
from filelake.plans import corpus, reports
from filelake.session import cut_lineage, ship_package

# The training-data operators and the pipeline are optional: without them the rest still works.
try:
    from filelake.llm.queries import ORACLE as LLM_ORACLE
    from filelake.llm.queries import QUERIES as LLM_QUERIES
except ModuleNotFoundError as missing:
    # A library that is missing takes them away as well, so its name is said.
    print(f"training-data queries left out: no module {missing.name}", file=sys.stderr)
    LLM_ORACLE, LLM_QUERIES = {}, {}
try:
    import corpus_pipeline
except ModuleNotFoundError:
    corpus_pipeline = None

HAMMING = 18
NEAR_HAMMING = 4
FAR_HAMMING = 12
COSINE = 0.40
TERM_COSINE = 0.95
EXCLUSIONS = ["src1", "/corpus/src2", "src1?", "*/src7/*"]
REFINE_PREFIXES = ["/corpus/src1", "/corpus/src12", "/pages"]
IMAGE_PREFIXES = ["/img/1", "/img/3"]
LANGUAGES = ["en", "es", "fr"]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: duplicate files of the corpus, each set with its oldest file as source."""
    return find_dupes(ship_package(spark), "/root/testdata/sf0.001")


# --- queries -------------------------------------------------------------------------


def file_metadata(spark, d):
    return corpus.file_index(spark, d).select(
        "path", paths.file_name(F.col("path")).alias("filename"), paths.suffix(paths.file_name(F.col("path"))).alias("ext"),
        paths.parent_dir(F.col("path")).alias("parent"), "size_bytes", "mtime", "crypto_hash", "mime_type",
        F.lit(False).alias("is_archived_file"),
    )


def scan_exclusion_filter(spark, d):
    return rules.exclude_paths(corpus.file_index(spark, d).select("path"), EXCLUSIONS)


def scan_default_rules(spark, d):
    return rules.default_rules(corpus.root_entries(spark, d))


def scan_junk_filter(spark, d):
    """Documents named by their language get junk and ordinary extensions."""
    kinds = {"de": ".TMP", "es": ".log", "fr": ".md"}
    ext = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in kinds.items()], F.lit(".txt"))
    docs = corpus.table(spark, d, "documents")
    listing = docs.select(F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"))
    return rules.drop_junk(listing)


def mime_detect(spark, d):
    typed = formats.with_format(corpus.with_bytes(corpus.file_index(spark, d)).drop("mime_type"))
    return typed.select("path", "mime_type")


def format_identify(spark, d):
    return formats.identify_formats(corpus.with_bytes(corpus.file_index(spark, d)))


def media_metadata(spark, d):
    return media.video_metadata(corpus.media_tracks(spark, d))


def audio_metadata(spark, d):
    return media.audio_metadata(corpus.audio_tags(spark, d))


def exif_projection(spark, d):
    return media.exif_names(corpus.exif_tags(spark, d))


def extract_text(spark, d):
    files = corpus.with_bytes(corpus.documents_as_files(spark, d))
    return files.select("path", text.extract_text(F.col("mime_type"), F.col("content")).alias("content"))


def extract_html_text(spark, d):
    files = corpus.with_bytes(corpus.pages_as_files(spark, d))
    return files.select("path", text.extract_text(F.col("mime_type"), F.col("content")).alias("content"))


def embed_text(spark, d):
    files = spread(corpus.documents_as_files(spark, d).select("path", "content"), "path")
    docs = vectors.with_embedding(files, "content", "v").select("path", "v")
    # The outer form, because the plain one tests its input first and so would encode twice.
    return docs.select("path", F.posexplode_outer("v").alias("dim", "w")).where("w <> 0").select("path", "dim", F.round("w", 6).alias("weight"))


def _with_pii(spark, d):
    files = spread(corpus.file_index(spark, d).select("path", "content"), "path")
    return files.select("path", pii.pii_types(F.col("content"), LANGUAGES).alias("pii_types"))


def pii_types(spark, d):
    return _with_pii(spark, d).select("path", F.array_join("pii_types", ",").alias("pii_types"))


def list_pii_files(spark, d):
    # The report's sort reads its input twice, so the types are found once, as in the index.
    return reports.list_pii_files(cut_lineage(_with_pii(spark, d)))


def format_bytes(spark, d):
    grown = F.col("size_bytes") * (F.col("mtime").cast("long") + 1)
    return corpus.file_index(spark, d).select(
        "path", paths.format_bytes(F.col("size_bytes")).alias("size"), paths.format_bytes(grown).alias("grown")
    )


def incremental_filter(spark, d):
    listing = corpus.documents_as_files(spark, d).select("path", "mtime")
    return incremental.changed_files(listing, corpus.old_index(spark, d))


def existing_only(spark, d):
    listing = corpus.labelled_paths(spark, d)
    return incremental.existing_only(corpus.file_index(spark, d).select("path", "size_bytes"), listing)


def refine_text_select(spark, d):
    return incremental.text_to_refine(corpus.pending_index(spark, d)).select("path", "mime_type", "size_bytes")


def refine_retry_select(spark, d):
    """Rows tried without an extractor for their type are taken again, the others are not."""
    return incremental.text_to_refine(corpus.tried_index(spark, d)).select("path", "mime_type", "size_bytes")


def refine_text_by_path(spark, d):
    chosen = incremental.text_to_refine_under(corpus.pending_index(spark, d), REFINE_PREFIXES)
    return chosen.select("path", "mime_type", "size_bytes")


def refine_image_select(spark, d):
    return incremental.images_to_refine_under(corpus.pending_index(spark, d), IMAGE_PREFIXES).select("path", "mime_type")


def refine_pending_counts(spark, d):
    return incremental.pending_counts(corpus.pending_index(spark, d))


def format_update(spark, d):
    index = corpus.file_index(spark, d).select("path", "mime_type", "pronom_id")
    return upsert.update_formats(index, corpus.format_hits(spark, d))


def format_update_by_path(spark, d):
    index = corpus.file_index(spark, d).select("path", "mime_type", "pronom_id")
    chosen = incremental.formats_to_refine_under(index, REFINE_PREFIXES).select("path")
    hits = corpus.format_hits(spark, d).join(chosen, "path", "left_semi")
    return upsert.update_formats(index, hits)


def upsert_replace(spark, d):
    """Changed documents and the last turn of every conversation go into an older index."""
    index = corpus.old_index(spark, d)
    docs = incremental.changed_files(corpus.documents_as_files(spark, d), index)
    turns = corpus.turns_as_files(spark, d)
    batch = upsert.latest_per_path(docs.unionByName(turns).withColumn("__order", F.col("mtime")), "__order")
    return upsert.upsert_replace(index, batch).select("path", "size_bytes", "mtime", "crypto_hash", "mime_type", "pronom_id")


def upsert_patch(spark, d):
    batch = corpus.labelled_paths(spark, d).select(
        "path", F.concat(F.lit("fmt/"), F.col("quality").cast("string")).alias("pronom_id"), F.lit("gone").alias("mime_type")
    )
    patched = upsert.upsert_patch(corpus.file_index(spark, d), batch, ["pronom_id"])
    return patched.select("path", "size_bytes", "crypto_hash", "mime_type", "pronom_id")


def find_dupes(spark, d):
    return reports.find_dupes(corpus.file_index(spark, d))


def lonely_files(spark, d):
    return reports.lonely_files(corpus.file_index(spark, d))


def lonely_files_count(spark, d):
    return reports.lonely_files_count(corpus.file_index(spark, d))


def largest_files(spark, d):
    return reports.largest_files(corpus.file_index(spark, d))


def type_summary(spark, d):
    return reports.type_summary(corpus.file_index(spark, d))


def pronom_summary(spark, d):
    return reports.pronom_summary(corpus.file_index(spark, d))


def scan_history(spark, d):
    return reports.scan_history(corpus.scan_log(spark, d))


def error_rollup(spark, d):
    return reports.error_rollup(corpus.errors(spark, d))


def image_dupes_exact(spark, d):
    return reports.image_dupes_exact(corpus.images_with_copies(spark, d))


def image_similar_pairs(spark, d):
    return similarity.similar_images(corpus.images_with_copies(spark, d), HAMMING)


def image_band_pairs(spark, d):
    return similarity.similar_images(corpus.images_with_copies(spark, d), HAMMING, method="bands")


def image_neighbour_pairs(spark, d):
    """A distance at which neighbours inside bands are sought."""
    return similarity.similar_images(corpus.images_with_near_copies(spark, d), FAR_HAMMING, method="neighbours")


def image_near_pairs(spark, d):
    """The threshold users work with, over images with planted near copies."""
    return similarity.similar_images(corpus.images_with_near_copies(spark, d), NEAR_HAMMING)


def image_similar_groups(spark, d):
    return reports.image_similar_groups(corpus.images_with_copies(spark, d), HAMMING)


def similar_text_pairs(spark, d):
    rows = corpus.vectors(spark, d).select("path", F.col("content_embedding").alias("embedding"))
    return similarity.similar_vectors(rows, COSINE).withColumn("cosine", F.round("cosine", 6))


def similar_text_groups(spark, d):
    return reports.similar_text_groups(corpus.vectors(spark, d), COSINE)


def similar_docs_sparse(spark, d):
    docs = corpus.table(spark, d, "documents").select(corpus.document_path().alias("path"), "text")
    return similarity.similar_documents(docs, TERM_COSINE).withColumn("cosine", F.round("cosine", 6))


def group_pairs(spark, d):
    return components.connected_components(corpus.graph_edges(spark, d))


def semantic_search(spark, d):
    index = corpus.vectors(spark, d)
    query = index.orderBy("vec_id").select("content_embedding").first()[0]
    return reports.semantic_search(index, query)


def search_text(spark, d):
    """Documents most like the first one that has words, given as a text."""
    docs = spread(corpus.documents_as_files(spark, d).select("path", "content", "mtime"), "path")
    text = docs.where(F.trim("content") != "").orderBy("mtime").select("content").first()[0]
    index = vectors.with_embedding(docs.select("path", "content"), "content", "content_embedding")
    return reports.search_text(index, text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator of the inventory that can run over the given tables."""
    listed = [
        file_metadata, scan_exclusion_filter, scan_default_rules, scan_junk_filter, mime_detect, format_identify,
        media_metadata, exif_projection, extract_text, extract_html_text, embed_text, pii_types, list_pii_files,
        format_bytes, incremental_filter, existing_only, refine_text_select, refine_text_by_path, refine_image_select,
        refine_pending_counts, format_update, format_update_by_path, upsert_replace, upsert_patch, find_dupes,
        lonely_files, lonely_files_count, largest_files, type_summary, pronom_summary, scan_history, error_rollup,
        image_dupes_exact, image_similar_pairs, image_band_pairs, image_similar_groups, similar_text_pairs,
        similar_text_groups, similar_docs_sparse, group_pairs, semantic_search,
        search_text, image_near_pairs, image_neighbour_pairs, audio_metadata, refine_retry_select,
    ]
    named = {f.__name__: f for f in listed} | LLM_QUERIES
    if corpus_pipeline:
        named["pipeline"] = corpus_pipeline.run
    return {name: _shipped(f) for name, f in named.items()}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package at hand in the Python workers."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(ship_package(spark), folder)

    return run


# --- the same in SQL -----------------------------------------------------------------

_DOC_PATH = "'/corpus/' || source || '/' || doc_id || '.txt'"
_DOCS = f"""docs AS (
  SELECT {_DOC_PATH} AS path, doc_id || '.txt' AS filename, strlen(text) AS size_bytes,
         CAST(doc_id AS DOUBLE) AS mtime, sha256(text) AS crypto_hash, 'text/plain' AS mime_type, text AS content,
         CASE lang WHEN 'en' THEN 'x-fmt/111' WHEN 'fr' THEN 'x-fmt/282' END AS pronom_id
  FROM documents)"""
_FILES = f"""{_DOCS}, files AS (
  SELECT * FROM docs UNION ALL
  SELECT '/pages/' || page_id || '.html', page_id || '.html', strlen(html), CAST(page_id + 1000000 AS DOUBLE),
         sha256(html), 'text/html', html, 'fmt/471' FROM pages)"""
_MARKS = f"marks AS (SELECT {_DOC_PATH} AS path, quality, toxic FROM documents JOIN labels USING (doc_id))"
_OLD = "old AS (SELECT docs.* REPLACE (mtime - quality AS mtime) FROM docs JOIN marks USING (path))"
_IMAGES = """images AS (
  SELECT vec_id, '/img/' || label || '/' || vec_id || '.png' AS path, 'image/png' AS mime_type, embedding,
         list_reduce(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1::UBIGINT ELSE 0::UBIGINT END),
                     lambda a, b: a * 2::UBIGINT + b) AS bits
  FROM embeddings),
copied AS (
  SELECT path, bits FROM images UNION ALL
  SELECT replace(path, '/img/', '/img/copy/'), bits FROM images WHERE vec_id IN (SELECT doc_id FROM labels)),
shown AS (SELECT path, bits, lower(lpad(printf('%x', bits), 16, '0')) AS perceptual_hash FROM copied)"""
_PENDING = f"""{_FILES}, {_MARKS}, {_IMAGES}, pending AS (
  SELECT path, mime_type, size_bytes, pronom_id, NULL AS perceptual_hash,
         CASE WHEN path NOT IN (SELECT path FROM marks) THEN content END AS content FROM files
  UNION ALL
  SELECT path, mime_type, NULL, NULL, CASE WHEN embedding[1] >= 0 THEN lower(lpad(printf('%x', bits), 16, '0')) END, NULL
  FROM images)"""
_PREFIXES = "(path LIKE '/corpus/src1/%' OR path LIKE '/corpus/src12/%' OR path LIKE '/pages/%')"
_HITS = """hits AS (
  SELECT path, CASE WHEN quality + toxic > 0 THEN 'fmt/1149' ELSE '' END AS puid,
         CASE WHEN toxic = 1 THEN 'application/octet-stream' WHEN quality = 1 THEN 'text/markdown' ELSE '' END AS mime
  FROM marks UNION ALL SELECT path, 'fmt/11', mime_type FROM images)"""
_EVENTS = "ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"


def _format_update(condition: str) -> str:
    return f"""WITH {_FILES}, {_MARKS}, {_IMAGES}, {_HITS}
    SELECT f.path, CASE WHEN h.path IS NOT NULL AND h.mime NOT IN ('', 'application/octet-stream') THEN h.mime
                        ELSE f.mime_type END AS mime_type, coalesce(h.puid, f.pronom_id) AS pronom_id
    FROM files f LEFT JOIN (SELECT * FROM hits WHERE puid <> '' AND {condition}) h ON f.path = h.path"""


# Written out by hand, apart from the rules under test.
_PII_KINDS = r"""
  CASE WHEN len(list_filter(regexp_extract_all(content, '\b\d{4}[ -]?\d{3,4}[ -]?\d{3,4}[ -]?\d{3,5}\b'), lambda m:
      list_sum(list_transform(range(1, len(regexp_replace(m, '[ -]', '', 'g')) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(regexp_replace(m, '[ -]', '', 'g')), i, 1) AS INTEGER)
        ELSE (2 * CAST(substr(reverse(regexp_replace(m, '[ -]', '', 'g')), i, 1) AS INTEGER)) // 10
           + (2 * CAST(substr(reverse(regexp_replace(m, '[ -]', '', 'g')), i, 1) AS INTEGER)) % 10 END)) % 10 = 0)) > 0
    THEN 'CREDIT_CARD' END,
  CASE WHEN len(list_filter(regexp_extract_all(content, '\b3\d{3}[ -]\d{6}[ -]\d{4}\b'), lambda m:
      list_sum(list_transform(range(1, 15), lambda i:
        CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(regexp_replace(m, '[ -]', '', 'g')), i, 1) AS INTEGER)
        ELSE (2 * CAST(substr(reverse(regexp_replace(m, '[ -]', '', 'g')), i, 1) AS INTEGER)) // 10
           + (2 * CAST(substr(reverse(regexp_replace(m, '[ -]', '', 'g')), i, 1) AS INTEGER)) % 10 END)) % 10 = 0)) > 0
    THEN 'CREDIT_CARD' END,
  CASE WHEN regexp_matches(content, '\b(?:bc1[ac-hj-np-z02-9]{25,71}|0x[[:xdigit:]]{40})\b') THEN 'CRYPTO' END,
  CASE WHEN regexp_matches(content, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 'EMAIL_ADDRESS' END,
  CASE WHEN len(list_filter(regexp_extract_all(content, '\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b'),
      lambda m: list_reduce(list_prepend(0, list_transform(
        string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''),
        lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
        lambda a, v: (a * (CASE WHEN v < 10 THEN 10 ELSE 100 END) + v) % 97) = 1)) > 0 THEN 'IBAN_CODE' END,
  CASE WHEN regexp_matches(content, '\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b')
         OR regexp_matches(content, '\b(?:[[:xdigit:]]{1,4}:){7}[[:xdigit:]]{1,4}\b')
         OR regexp_matches(content, '\b(?:[[:xdigit:]]{1,4}:){1,6}(?::[[:xdigit:]]{1,4}){1,6}\b') THEN 'IP_ADDRESS' END,
  CASE WHEN regexp_matches(content, '(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}\b') THEN 'PHONE_NUMBER' END,
  CASE WHEN regexp_matches(content, 'https?://[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 'URL' END,
  CASE WHEN regexp_matches(content, '\b\d{3}-\d{2}-\d{4}\b') THEN 'US_SSN' END,
  CASE WHEN regexp_matches(content, '\b9\d{2}[ -](?:5\d|6[0-5]|7\d|8[0-8]|9[0-24-9])[ -]\d{4}\b') THEN 'US_ITIN' END,
  CASE WHEN len(list_filter(regexp_extract_all(content, '\b\d{3}[ -]?\d{3}[ -]?\d{4}\b'), lambda m:
      list_sum(list_transform(range(1, 11), lambda i: CAST(substr(regexp_replace(m, '[ -]', '', 'g'), i, 1) AS INTEGER) * (11 - i))) % 11 = 0)) > 0
    THEN 'UK_NHS' END,
  CASE WHEN regexp_matches(content, '(?i:passport)[^\n]{0,30}?\b(?:[A-Z]\d{8}|\d{9})\b') THEN 'US_PASSPORT' END,
  CASE WHEN regexp_matches(content, '(?i:bank|account|acct)[^\n]{0,30}?\b\d{8,17}\b') THEN 'US_BANK_NUMBER' END,
  CASE WHEN regexp_matches(content, '(?i:driver.{0,3} licen[cs]e)[^\n]{0,30}?\b[A-Z]\d{4,14}\b') THEN 'US_DRIVER_LICENSE' END,
  CASE WHEN regexp_matches(content, '\b\d{8}[A-HJ-NP-TV-Z]\b') THEN 'ES_NIF' END,
  CASE WHEN regexp_matches(content, '\b[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}\b') THEN 'FR_NIR' END"""


def _pii(separator: str) -> str:
    return f"""{_FILES}, found AS (
      SELECT path, list_sort(list_distinct(list_filter([{_PII_KINDS}], lambda x: x IS NOT NULL))) AS kinds FROM files),
    pii AS (SELECT path, CASE WHEN len(kinds) > 0 THEN array_to_string(kinds, '{separator}') END AS pii_types FROM found)"""


def _size_text(size: str) -> str:
    units = ["B", "KB", "MB", "GB", "TB"]
    text_of = [f"printf('%.2f {u}', CAST({size} AS DOUBLE) / {1024**i})" for i, u in enumerate(units)]
    whens = " ".join(f"WHEN {size} < {1024 ** (i + 1)} THEN {text_of[i]}" for i in range(4))
    return f"CASE {whens} ELSE {text_of[4]} END"


def _image_edges(rows: str, limit: int) -> str:
    return f"""reps AS (SELECT bits, min(path) AS path FROM {rows} GROUP BY bits),
edges AS (
  SELECT r.path AS src, c.path AS dst, 0 AS distance FROM {rows} c JOIN reps r USING (bits) WHERE c.path <> r.path
  UNION ALL
  SELECT a.path, b.path, CAST(bit_count(xor(a.bits, b.bits)) AS INTEGER) FROM reps a JOIN reps b
    ON a.path < b.path AND bit_count(xor(a.bits, b.bits)) <= {limit})"""


_IMAGE_EDGES = f"{_IMAGES}, {_image_edges('copied', HAMMING)}"
_NEAR_EDGES = f"""{_IMAGES}, near AS (
  SELECT path, bits FROM copied UNION ALL
  SELECT replace(path, '/img/', '/img/near/'), xor(bits, 7::UBIGINT * CAST(pow(2, 61 - vec_id % 62) AS UBIGINT))
  FROM images WHERE vec_id IN (SELECT doc_id FROM labels))"""
_VECTOR_EDGES = f"""vecs AS (SELECT '/vec/' || vec_id AS path, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
reps AS (SELECT v, min(path) AS path FROM vecs GROUP BY v),
edges AS (
  SELECT r.path AS src, c.path AS dst, 1.0 AS cosine FROM vecs c JOIN reps r USING (v) WHERE c.path <> r.path
  UNION ALL
  SELECT a.path, b.path, list_cosine_similarity(a.v, b.v) FROM reps a JOIN reps b
    ON a.path < b.path AND list_cosine_similarity(a.v, b.v) >= {COSINE})"""


def _groups(edges: str, node: str) -> str:
    return f"""WITH RECURSIVE {edges},
    both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    reach(node, other) AS (
      SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
    labels_ AS (SELECT node, min(other) AS group_id FROM reach GROUP BY node)
    SELECT group_id, node AS {node}, count(*) OVER (PARTITION BY group_id) AS group_size FROM labels_"""


_TERMS = rf"""bags AS (
  SELECT {_DOC_PATH} AS path,
         list_sort(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0b]+'), lambda w: w <> '')) AS words
  FROM documents),
grouped AS (SELECT words, min(path) AS path FROM bags WHERE len(words) > 0 GROUP BY words),
tf AS (SELECT path, term, count(*) AS n FROM (SELECT path, unnest(words) AS term FROM grouped) GROUP BY path, term),
norms AS (SELECT path, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM tf GROUP BY path),
dots AS (SELECT a.path AS x, b.path AS y, CAST(sum(a.n * b.n) AS DOUBLE) AS d
         FROM tf a JOIN tf b ON a.term = b.term AND a.path < b.path GROUP BY a.path, b.path)"""


def oracle_sql() -> dict[str, str]:
    return _table_sql() | LLM_ORACLE


def _table_sql() -> dict[str, str]:
    dupes = f"{_FILES}, sized AS (SELECT *, count(*) OVER (PARTITION BY crypto_hash) AS set_size FROM files)"
    # Written out by hand, apart from the tables under test.
    windows = """'windows', 'programdata', 'program files', 'program files (x86)', 'pagefile.sys', 'hiberfil.sys', 'swapfile.sys',
      '$recycle.bin', 'system volume information', 'msocache'"""
    macos = """'.DocumentRevisions-V100', '.fseventsd', '.Spotlight-V100', '.Trashes', 'private', 'dev', 'System', 'Library',
      'Applications', 'Users/*/Library'"""
    # The tags that the events' numbers reach.
    tag_names = """WHEN 256 THEN 'ImageWidth' WHEN 257 THEN 'ImageLength' WHEN 258 THEN 'BitsPerSample' WHEN 259 THEN 'Compression'
      WHEN 262 THEN 'PhotometricInterpretation' WHEN 263 THEN 'Thresholding' WHEN 264 THEN 'CellWidth' WHEN 265 THEN 'CellLength'
      WHEN 266 THEN 'FillOrder' WHEN 269 THEN 'DocumentName' WHEN 270 THEN 'ImageDescription' WHEN 271 THEN 'Make' WHEN 272 THEN 'Model'
      WHEN 273 THEN 'StripOffsets' WHEN 274 THEN 'Orientation' WHEN 277 THEN 'SamplesPerPixel' WHEN 278 THEN 'RowsPerStrip'
      WHEN 279 THEN 'StripByteCounts' WHEN 280 THEN 'MinSampleValue' WHEN 281 THEN 'MaxSampleValue' WHEN 282 THEN 'XResolution'
      WHEN 283 THEN 'YResolution' WHEN 284 THEN 'PlanarConfiguration' WHEN 285 THEN 'PageName' WHEN 288 THEN 'FreeOffsets'
      WHEN 289 THEN 'FreeByteCounts' WHEN 290 THEN 'GrayResponseUnit' WHEN 291 THEN 'GrayResponseCurve' WHEN 292 THEN 'T4Options'
      WHEN 293 THEN 'T6Options' WHEN 296 THEN 'ResolutionUnit' WHEN 297 THEN 'PageNumber' WHEN 301 THEN 'TransferFunction'
      WHEN 305 THEN 'Software' WHEN 306 THEN 'DateTime' WHEN 315 THEN 'Artist' WHEN 316 THEN 'HostComputer' WHEN 317 THEN 'Predictor'
      WHEN 318 THEN 'WhitePoint' WHEN 319 THEN 'PrimaryChromaticities' WHEN 320 THEN 'ColorMap' WHEN 321 THEN 'HalftoneHints'
      WHEN 322 THEN 'TileWidth' WHEN 323 THEN 'TileLength' WHEN 324 THEN 'TileOffsets' WHEN 325 THEN 'TileByteCounts'
      WHEN 330 THEN 'SubIFDs' WHEN 332 THEN 'InkSet' WHEN 333 THEN 'InkNames' WHEN 334 THEN 'NumberOfInks' WHEN 336 THEN 'DotRange'
      WHEN 337 THEN 'TargetPrinter' WHEN 338 THEN 'ExtraSamples' WHEN 339 THEN 'SampleFormat' WHEN 340 THEN 'SMinSampleValue'
      WHEN 341 THEN 'SMaxSampleValue' WHEN 342 THEN 'TransferRange' WHEN 343 THEN 'ClipPath' WHEN 344 THEN 'XClipPathUnits'
      WHEN 345 THEN 'YClipPathUnits' WHEN 346 THEN 'Indexed' WHEN 347 THEN 'JPEGTables' WHEN 351 THEN 'OPIProxy'"""
    html_node = "regexp_replace({}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"
    return {
        "file_metadata": f"""WITH {_FILES} SELECT path, filename, regexp_extract(filename, '\\.[a-z]+$') AS ext,
            regexp_replace(path, '/[^/]*$', '') AS parent, size_bytes, mtime, crypto_hash, mime_type,
            false AS is_archived_file FROM files""",
        "scan_exclusion_filter": f"""WITH {_FILES} SELECT path FROM files
            WHERE NOT (path LIKE '%/src1/%' OR path LIKE '/corpus/src2/%' OR path LIKE '%/src7/%'
                       OR regexp_matches(path, '/src1[^/](/|$)'))""",
        "scan_default_rules": f"""WITH {_EVENTS}, entries AS (
              SELECT '/mnt/' || user_id || '-' || (k // 4) AS root,
                     CASE event_type WHEN 'error' THEN 'Windows' WHEN 'signup' THEN 'pagefile.sys'
                       WHEN 'view' THEN 'Library' WHEN 'click' THEN 'home' ELSE 'srv' END AS name FROM ev),
            kinds AS (SELECT root, CASE WHEN bool_or(name IN ('Windows', 'pagefile.sys', 'Program Files')) THEN 'windows'
                       WHEN bool_or(name IN ('System', 'Library', 'Applications')) THEN 'macos' END AS platform
                      FROM entries GROUP BY root)
            SELECT root, platform, root || '/' || unnest(CASE platform WHEN 'windows' THEN [{windows}] ELSE [{macos}] END)
              AS rule FROM kinds WHERE platform IS NOT NULL""",
        "scan_junk_filter": """SELECT '/corpus/' || source || '/' || doc_id ||
            CASE lang WHEN 'fr' THEN '.md' ELSE '.txt' END AS path FROM documents WHERE lang NOT IN ('de', 'es')""",
        "mime_detect": f"""WITH {_FILES} SELECT path, CASE
            WHEN size_bytes = 0 THEN 'inode/x-empty'
            WHEN regexp_matches(content, '^[ \\t\\n\\r]*(?i:<!doctype html|<html)') THEN 'text/html'
            WHEN regexp_matches(content, '^[ \\t\\n\\r]*<[?]xml ') THEN 'text/xml'
            WHEN starts_with(content, '%PDF-') THEN 'application/pdf'
            ELSE 'text/plain' END AS mime_type FROM files""",
        "format_identify": f"""WITH {_FILES} SELECT path, CASE
            WHEN regexp_matches(content, '^[ \\t\\n\\r]*(?i:<!doctype html)>') THEN 'fmt/471' ELSE 'fmt/96' END AS puid,
            'text/html' AS mime_type FROM files
            WHERE regexp_matches(content, '^[ \\t\\n\\r]*(?i:<!doctype html|<html)')""",
        "media_metadata": f"""WITH {_EVENTS}, t AS (
              SELECT '/media/' || user_id || '.mp4' AS path, event_id, k, value,
                     CASE event_type WHEN 'view' THEN 'Video' WHEN 'click' THEN 'Audio' END AS kind FROM ev),
            v AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY event_id) AS n FROM t WHERE kind = 'Video'),
            a AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY event_id) AS n FROM t WHERE kind = 'Audio')
            SELECT v.path, v.k * 16 AS width, v.k * 9 AS height, v.event_id * 10 AS duration_ms, v.value AS frame_rate,
                   'codec-' || v.k AS codec, 'format-' || v.k AS format, 'format-' || a.k AS audio_codec
            FROM v LEFT JOIN a ON v.path = a.path AND a.n = 1 WHERE v.n = 1""",
        "audio_metadata": f"""WITH {_EVENTS}, t AS (
              SELECT '/audio/' || user_id || '.mp3' AS path, event_id, k % 9 AS field, 'v' || k AS value FROM ev WHERE k % 10 <> 0),
            f AS (SELECT path, field, arg_min(value, event_id) AS value FROM t GROUP BY path, field)
            SELECT path, max(value) FILTER (field = 0) AS artist, max(value) FILTER (field = 1) AS album,
                   max(value) FILTER (field = 2) AS album_artist, max(value) FILTER (field = 3) AS title,
                   max(value) FILTER (field = 4) AS track, max(value) FILTER (field = 5) AS year,
                   max(value) FILTER (field = 6) AS duration_s, max(value) FILTER (field = 7) AS genre,
                   max(value) FILTER (field = 8) AS bitrate_kbps FROM f GROUP BY path""",
        "exif_projection": f"""WITH {_EVENTS}, t AS (
              SELECT '/photo/' || user_id || '.jpg' AS path, k + 256 AS tag_id, max(event_id) AS last FROM ev GROUP BY 1, 2)
            SELECT path, CASE tag_id {tag_names} ELSE CAST(tag_id AS VARCHAR) END AS tag, CAST(last AS VARCHAR) AS value
            FROM t""",
        "extract_text": f"""WITH {_DOCS}, t AS (
              SELECT path, regexp_replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'),
                     '^[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+|[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+$', '', 'g') AS s FROM docs)
            SELECT path, CASE WHEN s <> '' THEN s END AS content FROM t""",
        "extract_html_text": f"""WITH cut AS (
              SELECT '/pages/' || page_id || '.html' AS path, regexp_split_to_array(regexp_replace(html,
                '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<template.*?</template>', '<x>', 'g'),
                '(?s)<[/!a-zA-Z][^>]*>') AS parts FROM pages),
            nodes AS (SELECT path, list_filter(list_transform(parts, lambda p: {html_node.format(
                "replace(replace(replace(replace(p, '&middot;', '·'), '&copy;', '©'), '&quot;', chr(34)), '&amp;', '&')"
            )}), lambda p: p <> '') AS texts FROM cut)
            SELECT path, CASE WHEN len(texts) > 0 THEN array_to_string(texts, chr(10)) END AS content FROM nodes""",
        "embed_text": rf"""WITH {_DOCS}, w AS (
              SELECT path, unnest(regexp_split_to_array(lower(content), '[ \t\n\r\f\x0b]+')) AS word FROM docs),
            slots AS (SELECT path, CAST(('0x' || substr(md5(word), 1, 8)) AS UBIGINT) % {vectors.DIMENSIONS} AS dim, count(*) AS n
                      FROM w WHERE word <> '' GROUP BY 1, 2)
            SELECT path, CAST(dim AS INTEGER) AS dim,
                   round(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY path) AS DOUBLE)), 6) AS weight FROM slots""",
        "pii_types": f"WITH {_pii(',')} SELECT path, pii_types FROM pii",
        "list_pii_files": f"WITH {_pii(', ')} SELECT path, pii_types FROM pii WHERE pii_types IS NOT NULL ORDER BY path",
        "format_bytes": f"""WITH {_FILES}, t AS (SELECT path, size_bytes, size_bytes * (CAST(mtime AS BIGINT) + 1) AS grown FROM files)
            SELECT path, {_size_text('size_bytes')} AS size, {_size_text('grown')} AS grown FROM t""",
        "incremental_filter": f"""WITH {_DOCS}, {_MARKS}, {_OLD} SELECT docs.path, docs.mtime FROM docs
            LEFT JOIN old ON docs.path = old.path WHERE old.path IS NULL OR docs.mtime > old.mtime""",
        "existing_only": f"""WITH {_FILES}, {_MARKS} SELECT path, size_bytes FROM files
            WHERE path IN (SELECT path FROM marks)""",
        "refine_text_select": f"""WITH {_PENDING} SELECT path, mime_type, size_bytes FROM pending
            WHERE content IS NULL AND mime_type IN ('text/plain', 'text/html')""",
        "refine_retry_select": f"""WITH {_DOCS}, {_MARKS} SELECT path,
            CASE WHEN toxic = 1 THEN 'application/pdf' ELSE mime_type END AS mime_type, size_bytes
            FROM docs JOIN marks USING (path) WHERE toxic = 1 OR size_bytes > 104857600""",
        "refine_text_by_path": f"""WITH {_PENDING} SELECT path, mime_type, size_bytes FROM pending
            WHERE content IS NULL AND {_PREFIXES}""",
        "refine_image_select": f"""WITH {_PENDING} SELECT path, mime_type FROM pending WHERE mime_type LIKE 'image/%'
            AND perceptual_hash IS NULL AND (path LIKE '/img/1/%' OR path LIKE '/img/3/%')""",
        "refine_pending_counts": f"""WITH {_PENDING} SELECT count(*) AS files,
            count(*) FILTER (WHERE content IS NULL AND mime_type LIKE 'text/%') AS text_pending,
            count(*) FILTER (WHERE perceptual_hash IS NULL AND mime_type LIKE 'image/%') AS image_pending,
            count(*) FILTER (WHERE pronom_id IS NULL) AS format_pending FROM pending""",
        "format_update": _format_update("true"),
        "format_update_by_path": _format_update(_PREFIXES),
        "upsert_replace": f"""WITH {_DOCS}, {_MARKS}, {_OLD}, last AS (
              SELECT conv_id, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
            SELECT path, size_bytes, mtime, crypto_hash, mime_type, pronom_id FROM docs
            UNION ALL SELECT '/conv/' || conv_id || '.txt', strlen(text), CAST(turn AS DOUBLE), sha256(text), 'text/plain', NULL
            FROM last WHERE n = 1""",
        "upsert_patch": f"""WITH {_FILES}, {_MARKS} SELECT f.path, f.size_bytes, f.crypto_hash, f.mime_type,
            CASE WHEN m.path IS NULL THEN f.pronom_id ELSE 'fmt/' || m.quality END AS pronom_id
            FROM files f LEFT JOIN marks m ON f.path = m.path""",
        "find_dupes": f"""WITH {dupes} SELECT crypto_hash, set_size,
            CASE row_number() OVER (PARTITION BY crypto_hash ORDER BY mtime, path) WHEN 1 THEN 'Source' ELSE 'Dup' END AS role,
            path, size_bytes, mtime FROM sized WHERE set_size > 1 ORDER BY crypto_hash, mtime, path""",
        "lonely_files": f"""WITH {dupes} SELECT path, size_bytes, crypto_hash FROM sized WHERE set_size = 1
            ORDER BY size_bytes DESC, path LIMIT 20""",
        "lonely_files_count": f"WITH {dupes} SELECT count(*) AS unique_files FROM sized WHERE set_size = 1",
        "largest_files": f"WITH {_FILES} SELECT path, size_bytes FROM files ORDER BY size_bytes DESC, path LIMIT 20",
        "type_summary": f"""WITH {_FILES} SELECT mime_type, count(*) AS file_count,
            CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM files GROUP BY mime_type ORDER BY file_count DESC, mime_type""",
        "pronom_summary": f"""WITH {_FILES} SELECT pronom_id, count(*) AS file_count,
            CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM files WHERE pronom_id IS NOT NULL
            GROUP BY pronom_id ORDER BY file_count DESC, pronom_id""",
        "scan_history": f"""WITH {_EVENTS}, l AS (
              SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS scan_id, ts, date_trunc('day', ts) AS day, k, event_type,
                     row_number() OVER (PARTITION BY user_id, date_trunc('day', ts)
                                        ORDER BY ts DESC, event_type IN ('purchase', 'error') DESC) AS n FROM ev)
            SELECT scan_id, CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'STARTED' END
                     AS status, strftime(day, '%Y-%m-%d %H:%M:%S') AS started,
                   CASE WHEN event_type IN ('purchase', 'error') THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                        ELSE 'In Progress' END AS ended, k AS files_scanned
            FROM l WHERE n = 1 ORDER BY day DESC, scan_id LIMIT 50""",
        "error_rollup": f"""WITH {_EVENTS}, e AS (
              SELECT ts, '/data/' || user_id || '/' || event_id || '.bin' AS path, 'Could not read ''/data/' || user_id || '/'
                     || event_id || '.bin'': code ' || (k // 10) AS message, 'Could not read <PATH>: code ' || (k // 10) AS kind
              FROM ev WHERE event_type = 'error'),
            r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts, path, message) AS occurrence,
                         count(*) OVER (PARTITION BY kind) AS total FROM e)
            SELECT kind, CAST(occurrence AS INTEGER) AS occurrence, ts, message, greatest(total - 5, 0) AS suppressed
            FROM r WHERE occurrence <= 5""",
        "image_dupes_exact": f"""WITH {_IMAGES}, g AS (
              SELECT perceptual_hash, path, count(*) OVER (PARTITION BY perceptual_hash) AS group_size FROM shown)
            SELECT perceptual_hash, group_size, path FROM g WHERE group_size > 1 ORDER BY perceptual_hash, path""",
        "image_similar_pairs": f"WITH {_IMAGE_EDGES} SELECT src, dst, distance FROM edges",
        "image_band_pairs": f"WITH {_IMAGE_EDGES} SELECT src, dst, distance FROM edges",
        "image_near_pairs": f"WITH {_NEAR_EDGES}, {_image_edges('near', NEAR_HAMMING)} SELECT src, dst, distance FROM edges",
        "image_neighbour_pairs": f"WITH {_NEAR_EDGES}, {_image_edges('near', FAR_HAMMING)} SELECT src, dst, distance FROM edges",
        "image_similar_groups": _groups(_IMAGE_EDGES, "path"),
        "similar_text_pairs": f"WITH {_VECTOR_EDGES} SELECT src, dst, round(cosine, 6) AS cosine FROM edges",
        "similar_text_groups": _groups(_VECTOR_EDGES, "path"),
        "similar_docs_sparse": f"""WITH {_TERMS}
            SELECT g.path AS src, b.path AS dst, 1.0::DOUBLE AS cosine FROM bags b JOIN grouped g USING (words) WHERE b.path <> g.path
            UNION ALL SELECT x, y, round(d / (nx.norm * ny.norm), 6) FROM dots
            JOIN norms nx ON nx.path = x JOIN norms ny ON ny.path = y WHERE d / (nx.norm * ny.norm) >= {TERM_COSINE}""",
        "group_pairs": _groups("""edges AS (
              SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION ALL
              SELECT 't' || conv_id || '-' || turn, 't' || conv_id || '-' || (turn - 1) FROM conversations WHERE turn > 0)""", "node"),
        "search_text": rf"""WITH {_DOCS}, w AS (
              SELECT path, unnest(regexp_split_to_array(lower(content), '[ \t\n\r\f\x0b]+')) AS word FROM docs),
            tf AS (SELECT path, CAST(('0x' || substr(md5(word), 1, 8)) AS UBIGINT) % {vectors.DIMENSIONS} AS dim, count(*) AS n
                   FROM w WHERE word <> '' GROUP BY 1, 2),
            norms AS (SELECT path, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM tf GROUP BY path),
            q AS (SELECT path FROM docs WHERE trim(content) <> '' ORDER BY mtime LIMIT 1),
            dots AS (SELECT a.path, CAST(sum(a.n * b.n) AS DOUBLE) AS dot FROM tf a JOIN tf b ON a.dim = b.dim
                     WHERE b.path IN (SELECT path FROM q) GROUP BY a.path),
            s AS (SELECT n.path, coalesce(dot, 0) / (n.norm * (SELECT norm FROM norms WHERE path IN (SELECT path FROM q))) AS c
                  FROM norms n LEFT JOIN dots d ON n.path = d.path)
            SELECT path, round(c, 4) AS score FROM s ORDER BY round(c, 12) DESC, path LIMIT 10""",
        "semantic_search": f"""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1),
            s AS (SELECT '/vec/' || vec_id AS path, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS c FROM embeddings, q)
            SELECT path, round(c, 4) AS score FROM s ORDER BY c DESC, path LIMIT 10""",
    }
