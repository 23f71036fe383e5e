"""Document fingerprints: Merkle trees over paragraphs and sections, on DataFrame functions alone.

A paragraph is a line and its node the SHA-256 of its bytes. A section is a run of
paragraphs that ends where a paragraph's digest starts with ``0`` or ``1``, so sections
find their places again after an insertion; its node is the SHA-256 of its paragraphs'
digests, and the root that of the sections' digests. Roots are equal exactly for equal
texts. Below the paragraphs lie pieces, up to eight words ending at punctuation, whose
64-bit hashes tell how alike two texts are when only parts of a paragraph differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filelake.llm.common import let, literal_longs

PIECE = r"(?:\S{0,63}[^\s\p{Punct}]\s+){0,7}\S{1,64}\s*"
RANGE_ROWS = 1024
MAX_RANGES = 1 << 16


def paragraph_digests(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda p: F.sha2(p.cast("binary"), 256))


def section_digests(paragraphs: Column) -> Column:
    def build(ps: Column) -> Column:
        count = F.size(ps)
        ends = F.filter(F.sequence(F.lit(1), count), lambda i: F.element_at(ps, i).rlike("^[01]") | (i == count))

        def cut(es: Column) -> Column:
            def section(e: Column, k: Column) -> Column:
                start = F.when(k == 0, F.lit(1)).otherwise(F.get(es, k - 1) + 1)
                return F.sha2(F.array_join(F.slice(ps, start, e - start + 1), "").cast("binary"), 256)

            return F.transform(es, section)

        return let(ends, cut)

    return let(paragraphs, build)


def root_digest(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, "").cast("binary"), 256)


def piece_hashes(text: Column) -> Column:
    """Distinct hashes of a text's pieces."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x)))


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the tree of a text: ``<name>_root``, ``_sections``, ``_paragraphs``, ``_pieces``. NULL counts as empty."""
    df = df.withColumn(f"{name}_paragraphs", paragraph_digests(F.coalesce(text, F.lit(""))))
    df = df.withColumn(f"{name}_sections", section_digests(F.col(f"{name}_paragraphs")))
    df = df.withColumn(f"{name}_root", root_digest(F.col(f"{name}_sections")))
    return df.withColumn(f"{name}_pieces", piece_hashes(F.coalesce(text, F.lit(""))))


def likeness(a: str, b: str) -> Column:
    """Twice the common pieces over all pieces of two trees; 1 for equal roots only."""
    pa, pb = F.col(f"{a}_pieces"), F.col(f"{b}_pieces")
    total = F.size(pa) + F.size(pb)
    dice = F.when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(pa, pb)) / total)
    below = 1.0 - 1.0 / (total + 2)
    return F.when(F.col(f"{a}_root") == F.col(f"{b}_root"), 1.0).otherwise(F.least(dice, below))


def first_difference(a: str, b: str) -> Column:
    """Number (from 1) of the first paragraph in which two trees differ; NULL if they are equal."""
    pa, pb = F.col(f"{a}_paragraphs"), F.col(f"{b}_paragraphs")
    places = F.sequence(F.lit(1), F.greatest(F.size(pa), F.size(pb)))
    differs = F.filter(places, lambda i: ~F.try_element_at(pa, i).eqNullSafe(F.try_element_at(pb, i)))
    return F.try_element_at(differs, F.lit(1))


def _range_of(ids: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below an id, by binary search; NULL ids come first of all."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    array = literal_longs(bounds)

    def probe(pos: Column, step: Column) -> Column:
        here = F.try_element_at(array, pos + step)
        return F.when(here.isNotNull() & (here <= ids), pos + step).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), probe)


def with_next_text(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: the text of the next document by falling ``doc_id``, the first after the last.

    Ids are cut into ranges at their quantiles (at most ``MAX_RANGES`` bounds reach the
    driver), and every range also gets a copy of the first row of the range below it, so one
    exchange by range is enough and no range waits for another. NULL ids come last; equal ids
    follow each other by a hash of their text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    count = docs.count()
    ranges = max(1, min(MAX_RANGES, -(-count // RANGE_ROWS)))
    bounds: list[int] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * ranges)).alias("b")).first()["b"]
        bounds = sorted({int(b) for b in found or []})
    own = _range_of(F.col("doc_id"), bounds)
    tops = docs.select(own.alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("top")).collect()
    tops = sorted((r["part"], r["top"]) for r in tops)
    top_of, goes_to = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for place, (part, top) in enumerate(tops):
        top_of[part] = top
        goes_to[part] = tops[(place + 1) % len(tops)][0]
    placed = rows.withColumn("part", own)
    is_top = F.col("doc_id").eqNullSafe(F.get(literal_longs(top_of), F.col("part")))
    guest = F.struct(F.get(literal_longs(goes_to), F.col("part")).cast("int").alias("part"), F.lit(1).alias("guest"))
    stays = F.struct(F.col("part").cast("int").alias("part"), F.lit(0).alias("guest"))
    placed = placed.withColumn("at", F.explode(F.when(is_top, F.array(stays, guest)).otherwise(F.array(stays))))
    placed = placed.select("doc_id", "text", "at.part", "at.guest")
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return placed.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next_text")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    The edit replaces the last third of the characters (rounded down) by the beginning of the
    next document. Reads ``doc_id, text``, ignores other columns. NULL is empty; an empty text
    has a root like any other, likeness 1 to an empty text and 0 to any other; repeated rows
    and equal texts get equal fingerprints; a single document is its own next one; an empty
    table gives no row.
    """
    rows = with_next_text(docs)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited)
    for text, name in (("text", "own"), ("edited", "new"), ("next_text", "next")):
        rows = with_tree(rows, text, name)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("own_root").alias("fingerprint"),
        F.col("new_root").alias("edited_fingerprint"),
        likeness("own", "new").alias("near_edited"),
        likeness("own", "next").alias("near_next"),
        F.size("own_paragraphs").alias("n_paragraphs"),
        F.size("own_sections").alias("n_sections"),
        first_difference("own", "new").alias("first_edited_paragraph"),
    )
