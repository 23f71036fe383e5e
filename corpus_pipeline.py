"""A corpus pipeline: language, near duplicates, personal data, mixture, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``; all but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.llm import jaccard, langid, mixing, packing, surrogates
from filelake.llm.common import prepare, stored, table

TOKENIZER = "byte_bpe_50k.json"
SURROGATE_KEY = b"example key of the pipeline"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus: those without letters or far from every profile go.

    A missing language is filled in; one that is given stays.
    """
    prepare(spark)
    held = F.coalesce(langid.is_held_out(F.col("doc_id")), F.lit(False)) | F.col("doc_id").isNull()
    profiles = langid.train_profiles(docs.where(~held).select("text", "lang"))
    # The text goes in twice: once to be read, once to be kept.
    found = langid.identify(docs.select(*COLUMNS, F.col("text").alias("kept_text")).select("text", "doc_id", "kept_text", "lang", "source", "n_chars"), profiles)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= langid.MIN_SCORE))
    return kept.select("doc_id", F.col("kept_text").alias("text"), F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the least id.

    Rows of one id count as one document, of which the row of the least text stays; rows
    without an id stay.
    """
    prepare(spark)
    groups = jaccard.jaccard_components(docs)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).where("doc_id is not null").join(gone, "doc_id", "left_anti")
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = kept.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", *[f"row.{c}" for c in rest])
    return one.unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; ``n_chars`` follows the new text."""
    prepare(spark)
    hidden = surrogates.replace_entities(docs.select(*COLUMNS), SURROGATE_KEY)
    return hidden.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it, which may be never."""
    prepare(spark)
    return mixing.take_mixture(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack_documents(prepare(spark) and docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard", drop_near_duplicates),
    ("pii_surrogates", hide_personal_data),
    ("source_mixing", mix_to_targets),
    ("pattern_packing", pack_sequences),
]

# Neither the rank-order profiles nor the packing can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
