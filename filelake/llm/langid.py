"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the list of the most frequent letter n-grams (1 to 3, words padded with
blanks) of a language, by falling count. A text's own list is compared to each profile: an
n-gram costs the difference of its two ranks, or the profile's length where it is missing.
The language with the least sum wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 300
UNKNOWN = "und"
# A text is rejected below this score; wrong scripts and symbols come out near 0.
MIN_SCORE = 0.10
_STRIDE = 1 << 20
_FLUSH = 400_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(part: str) -> np.ndarray:
    points = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(_letters()[points], points, 32)
    points = np.concatenate(([32], points, [32]))
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
    two = points[:-1] << 21 | points[1:]
    three = (two[:-1] << 21 | points[2:])[points[1:-1] != 32]  # within a word and its blanks
    return np.concatenate((points[points != 32], two, three))


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the whole text, as numbers in rising order, and their counts; both empty without letters."""
    grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return grams, counts
    start = 0
    while start < len(text):
        end = start + _STRIDE
        while end < len(text) and not text[end].isspace() and end < start + 2 * _STRIDE:
            end += 1
        codes = _codes(text[start:end])
        start = end
        if len(codes) <= 1:  # blanks only
            continue
        g, c = np.unique(codes, return_counts=True)
        grams, counts = _added(np.concatenate((grams, g)), np.concatenate((counts, c))) if len(grams) else (g, c)
    return grams, counts


def _added(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[first], np.add.reduceat(counts, first)


def _ranked(grams: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    return grams[np.argsort(-counts, kind="stable")[:length]]


def _count_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[list, list]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (gs, cs) in held.items():
            g, c = _added(np.concatenate(gs), np.concatenate(cs))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(c)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            g, c = gram_counts(text)
            if len(g):
                gs, cs = held.setdefault(lang, ([], []))
                gs.append(g)
                cs.append(c)
                size += len(g)
        if size > _FLUSH:
            yield from flush()
            size = 0
    yield from flush()


def train_profiles(labelled: DataFrame, length: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of all rows of ``labelled (text, lang)``: ``length`` n-grams per language reach the driver.

    Counts cover every text. Rows without a language or without letters teach nothing.
    """
    rows = labelled.where("lang is not null").select("text", "lang")
    counts = rows.mapInArrow(_count_task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)
    profiles: dict[str, list[int]] = {}
    for row in sorted(top.select("lang", "rank", "gram").collect()):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Classifier:
    """Out-of-place distances of a text to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], length: int = PROFILE):
        self.length = length
        self.langs = sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[lang], np.int64)), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = gram_counts(text)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        own = _ranked(grams, counts, self.length)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        theirs = np.where((self.grams[at] == own)[:, None], self.ranks[at], -1)
        places = np.arange(len(own))[:, None]
        distance = np.where(theirs >= 0, np.abs(theirs - places), self.length).sum(0)
        best = int(distance.argmin())
        return self.langs[best], float(1.0 - distance[best] / (self.length * len(own)))


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def identify(docs: DataFrame, profiles: dict[str, list[int]], length: int = PROFILE) -> DataFrame:
    """``docs (doc_id, text, ...)`` with ``lang_pred, score`` in place of ``text``; other columns pass through."""
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(profiles, length)
        for batch in batches:
            found = [classifier.predict(t) for t in batch.column("text").to_pylist()]
            lang, score = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lang, score], [*names, "lang_pred", "score"])

    return docs.mapInArrow(task, f"{schema}, lang_pred string, score double")


def predict_languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs (doc_id, text, lang)``.

    Learns from the rows that are not held out and have a language. A NULL text, a text without
    a letter, and every text if nothing could be learned get ``und`` and score 0. A NULL
    ``doc_id`` is not held out and teaches nothing. Repeated rows count as often as they occur;
    equal distances go to the first language by code point; other columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang")
    held = F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))
    profiles = train_profiles(rows.where(~held & F.col("doc_id").isNotNull()))
    return identify(rows.select("doc_id", held.alias("held_out"), "text"), profiles)
