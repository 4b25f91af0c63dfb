"""Language identification by rank-order n-gram profiles.

A text's letters, lower-cased, form words padded by one blank on either side; its profile is its `top` most frequent
1- to 3-grams. The out-of-place distance to a language sums, over the text's profile, how far each n-gram stands from
its place in the language's profile; an n-gram that is missing there counts `top`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOP = 300
PIECE = 1 << 20
BLANK = 1
_letters: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Code points, with BLANK for what isn't a letter."""
    if not _letters:
        _letters.append(np.array([0 <= c < 0xD800 and chr(c).isalpha() or c > 0xDFFF and chr(c).isalpha() for c in range(0x110000)]))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(_letters[0][points], points, BLANK)


def _grams(points: np.ndarray, skip: int) -> np.ndarray:
    """All n-grams that end at place `skip` or later; an n-gram holds blanks at its ends only. 21 bits a character."""
    a, b = points[:-1], points[1:]
    one = points[skip:]
    two = (a << 21 | b)[max(0, skip - 1) :][((a != BLANK) | (b != BLANK))[max(0, skip - 1) :]]
    three = ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[max(0, skip - 2) :][(points[1:-1] != BLANK)[max(0, skip - 2) :]]
    return np.concatenate([one[one != BLANK], two, three])


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the whole text and their counts, from pieces that overlap by two characters."""
    text = text.lower()
    parts = []
    for at in range(0, max(1, len(text)), PIECE):
        end = min(at + PIECE, len(text))
        points = _codes(("" if at else " ") + text[max(0, at - 2) : end] + (" " if end == len(text) else ""))
        parts.append(np.unique(_grams(points, min(2, at)), return_counts=True))
    if len(parts) == 1:
        return parts[0]
    grams, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _add(total: tuple, more: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, place = np.unique(np.concatenate([total[0], *(m[0] for m in more)]), return_inverse=True)
    return grams, np.bincount(place, np.concatenate([total[1], *(m[1] for m in more)])).astype(np.int64)


def fit(labelled: DataFrame, top: int = TOP) -> dict[str, list[int]]:
    """The `top` most frequent n-grams of each language over all rows of labelled (lang, text); ties go to the lower code.

    Counts are summed per Arrow batch, then by Spark; the driver gets `top` rows for each language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            totals: dict[str, tuple] = {}
            waiting: dict[str, list] = {}
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                waiting.setdefault(lang, []).append(ngram_counts(text.as_py()))
                if len(waiting[lang]) >= 200:
                    totals[lang] = _add(totals.get(lang, none), waiting.pop(lang))
            for lang, more in waiting.items():
                totals[lang] = _add(totals.get(lang, none), more)
            for lang, (grams, counts) in totals.items():
                yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found: dict[str, list[int]] = {}
    for row in counts.withColumn("place", place).where(F.col("place") <= top).orderBy("lang", "place").collect():
        found.setdefault(row.lang, []).append(row.gram)
    return found


def predict(docs: DataFrame, profiles: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """All columns of docs, then lang_pred and score.

    lang_pred is the language at the least distance (ties: the first name); `und` where text is null or has no letter, or
    where there is no profile. score is 1 - distance / the greatest possible distance, 0 for `und`. Columns of
    docs with these two names are replaced.
    """
    names = sorted(profiles)
    grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
    places = np.full((len(grams), len(names)), -1, np.int64)
    for j, name in enumerate(names):
        places[np.searchsorted(grams, profiles[name]), j] = np.arange(len(profiles[name]))

    def one(text: str | None) -> tuple[str, float]:
        own, counts = ngram_counts(text or "")
        if not len(own) or not names:
            return "und", 0.0
        if len(own) > top:
            enough = np.partition(counts, len(counts) - top)[len(counts) - top]
            own, counts = own[counts >= enough], counts[counts >= enough]
        own = own[np.argsort(-counts, kind="stable")[:top]]
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        theirs = np.where((grams[at] == own)[:, None], places[at], -1)
        away = np.where(theirs < 0, top, np.abs(theirs - np.arange(len(own))[:, None])).sum(0)
        best = int(away.argmin())
        return names[best], float(1 - away[best] / (top * len(own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    docs = docs.drop("lang_pred", "score")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row. Only rows that aren't held out and have a lang are learned from.

    A null doc_id counts as empty text: it isn't held out. Repeated rows stay and count as often as they occur; equal texts
    have equal predictions. Texts of any length are read whole. An empty table gives no rows.
    """
    profiles = fit(docs.where(~held_out()))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")
