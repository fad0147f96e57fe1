"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (one to three letters, words padded with a
space), most frequent first. A document is ranked the same way over its whole text, and the language whose
profile is nearest by the out-of-place distance wins: the sum over the document's n-grams of how far
each stands from its place in the profile, ``size`` places where it is not there.

Profiles are learnt from at most ``per_language`` documents of each language, those with the smallest
hashed ids; everything else reads all documents.

Defined results: null text or text without a letter is ``und`` with score 0, as is any text when
nothing was learnt; n-grams that tie in count rank by code point, languages that tie by name; rows that repeat
are each answered; null ids are kept and never learnt from. The score is second / (best + second) of
the two smallest distances, 1 for a language that stands alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN, SPACE = "und", 32
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once in each process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text, in no order; empty where it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    kept = np.where(letters()[points], points, SPACE).astype(np.int64)
    padded = np.concatenate(([SPACE], kept, [SPACE]))
    padded = padded[np.r_[True, (padded[1:] != SPACE) | (padded[:-1] != SPACE)]]
    if len(padded) < 3:
        return np.array([], dtype=np.int64)
    pairs = (padded[:-1] << 21) | padded[1:]
    triples = ((pairs[:-1] << 21) | padded[2:])[padded[1:-1] != SPACE]
    return np.concatenate((padded[padded != SPACE], pairs, triples))


def ranked(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent codes, most frequent first, and their counts."""
    codes = np.sort(codes)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.array([], dtype=int)
    counts = np.diff(np.r_[starts, len(codes)])
    first = np.argsort(-counts, kind="stable")[:size]
    return codes[starts][first], counts[first]


@dataclass(frozen=True)
class Profiles:
    """Places of the known n-grams in each language's profile; ``size`` where one is not there."""

    languages: list[str]
    codes: np.ndarray
    places: np.ndarray
    size: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]], size: int) -> Profiles:
        """From (language, code, place)."""
        languages = sorted({r[0] for r in rows})
        codes = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        places = np.full((len(languages), len(codes)), size, dtype=np.int64)
        for language, code, place in rows:
            places[languages.index(language), np.searchsorted(codes, code)] = place
        return cls(languages, codes, places, size)

    def answer(self, text: str | None) -> tuple[str, float]:
        codes, _ = ranked(ngrams(text or ""), self.size)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        places = np.where(known, self.places[:, at], self.size)
        off = np.where(places < self.size, np.abs(places - np.arange(len(codes))), self.size)
        distances = off.sum(axis=1) / (self.size * len(codes))
        order = np.argsort(distances, kind="stable")
        if len(order) == 1:
            return self.languages[0], 1.0
        best, second = float(distances[order[0]]), float(distances[order[1]])
        return self.languages[order[0]], second / (best + second) if best + second else 0.5


def learn(docs: DataFrame, learnable: Column, size: int = 400, per_language: int = 1000,
          doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles from the learnable rows; the driver sees ``size`` rows a language."""
    rows = docs.filter(learnable & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    # Two cuts: by the share of hashes that holds about twice as many, then exactly, so a common language is no hot key.
    counts = rows.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    near = (rows.select(F.col(lang).alias("lang"), F.col(doc_id).alias("__id"), F.xxhash64(doc_id).alias("hash"))
            .join(F.broadcast(counts), "lang")  # one row for each language
            .filter(F.pmod("hash", F.lit(2**31)) * F.col("n") <= F.lit(2.0**31 * (2 * per_language + 50))))
    order = Window.partitionBy("lang").orderBy("hash", "__id")
    chosen = (near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language)
              .select("lang", "__id").distinct())
    picked = (rows.select(F.col(doc_id).alias("__id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
              .join(F.broadcast(chosen), ["__id", "lang"]).select("lang", "text"))  # at most per_language ids a language

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, texts in batch.groupby("lang")["text"]:
                codes, counts = ranked(np.concatenate([ngrams(t) for t in texts]), 2**62)
                yield pd.DataFrame({"lang": language, "code": codes, "n": counts})

    totals = picked.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    places = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    top = totals.withColumn("place", F.row_number().over(places) - 1).filter(F.col("place") < size)
    return Profiles.of([(r.lang, r.code, r.place) for r in top.select("lang", "code", "place").collect()], size)


def predict(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [profiles.answer(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": [a for a, _ in answers], "score": [s for _, s in answers]})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(
        apply, "doc_id long, lang_pred string, score double")
