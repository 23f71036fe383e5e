"""Vector expressions and text encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 384
_TEXT, _SLOTS, _COUNTS, _WEIGHTED, _VECTOR = "__text_in", "__slots", "__counts", "__weighted", "__unit"


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine of a vector column and a constant vector, in double; 0 for a zero vector."""
    unit = np.asarray(query, dtype=np.float64)
    length = float(np.linalg.norm(unit))

    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        rows = np.stack(batch.to_numpy()).astype(np.float64) if len(batch) else np.zeros((0, unit.size))
        norms = np.linalg.norm(rows, axis=1) * length
        return pd.Series(np.divide(rows @ unit, norms, out=np.zeros(len(rows)), where=norms > 0))

    return score(vector)


def word_stages(dimensions: int = DIMENSIONS) -> list[Transformer]:
    """Text to counts of word slots, as Spark ML stages: lower-cased words, hashed to ``dimensions`` slots.

    The counts of a text depend on that text only, so rows written by different scans stay
    comparable. All words of the text count.
    """
    words = f"filter(split(lower({_TEXT}), '[ \\\\t\\\\n\\\\r\\\\f\\\\x0b]+'), w -> w <> '')"
    slots = f"transform({words}, w -> cast(cast(conv(substr(md5(w), 1, 8), 16, 10) as bigint) % {dimensions} as string))"
    split = SQLTransformer(statement=f"SELECT *, coalesce({slots}, array()) AS {_SLOTS} FROM __THIS__")
    count = CountVectorizerModel.from_vocabulary([str(i) for i in range(dimensions)], inputCol=_SLOTS, outputCol=_COUNTS)
    return [split, count]


@cache
def word_encoder(dimensions: int = DIMENSIONS) -> PipelineModel:
    """The default encoder: unit vectors of word counts; needs no fitting."""
    return PipelineModel([*word_stages(dimensions), Normalizer(inputCol=_COUNTS, outputCol=_VECTOR)])


def fit_encoder(texts: DataFrame, text: str, dimensions: int = DIMENSIONS) -> PipelineModel:
    """An encoder that weighs slots by inverse document frequency over ``texts``.

    It is saved and loaded with Spark ML (``model.save(path)``, ``PipelineModel.load(path)``);
    rows are comparable if they were encoded with the same one.
    """
    counted = PipelineModel(word_stages(dimensions)).transform(texts.where(F.col(text).isNotNull()).select(F.col(text).alias(_TEXT)))
    weights = IDF(inputCol=_COUNTS, outputCol=_WEIGHTED).fit(counted)
    return PipelineModel([*word_stages(dimensions), weights, Normalizer(inputCol=_WEIGHTED, outputCol=_VECTOR)])


def with_embedding(rows: DataFrame, text: str, out: str, encoder: PipelineModel | None = None) -> DataFrame:
    """Add ``out``, the embedding of the column ``text`` as ``array<double>``; NULL for NULL or empty text."""
    encoded = (encoder or word_encoder()).transform(rows.withColumn(_TEXT, F.col(text)))
    vector = F.when(F.length(_TEXT) > 0, vector_to_array(F.col(_VECTOR)))
    return encoded.withColumn(out, vector).drop(_TEXT, _SLOTS, _COUNTS, _WEIGHTED, _VECTOR)


def embed_text(text: Column, make_encoder: Callable[[], Callable[[str], np.ndarray]]) -> Column:
    """Embedding of a text by a Python encoder as ``array<double>``; NULL for NULL or empty text.

    ``make_encoder`` is called once per Python worker task, which is where a neural model
    would be loaded.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for batch in batches:
            yield pd.Series([encode(t) if t else None for t in batch], index=batch.index, dtype=object)

    # Marked as not repeatable, so that the optimizer does not copy the work into filters.
    return run.asNondeterministic()(text)
