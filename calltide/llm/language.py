"""Operator 5, language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (1 to 3 letters, with
word boundaries) of a language, in order. A document's own most frequent
n-grams are compared with each profile by out-of-place distance: the sum over
its n-grams of the difference of the two ranks, or the profile length where
the profile lacks the n-gram. The nearest profile wins.

Counting covers the whole text of every document that is learned from; counts
are added up per batch before they are shuffled, and the top of each profile
is taken in two steps, so that no task holds a language.

Defined cases: `und` with score 0 if the text is missing or has no letter, or
if nothing was learned; ties go to the language that sorts first; repeated rows
count and are predicted alike; a missing lang is not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

PROFILE = 400
UNKNOWN = "und"
BITS = np.int64(21)  # a code point
#: The code of a word boundary; 0 would make a letter after it look like the letter alone.
EDGE = 1


@cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else EDGE."""
    table = np.full(0x110000, EDGE, np.int64)
    codes = [i for i in range(0x110000) if chr(i).isalpha()]
    table[codes] = codes
    return table


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text as integers, ascending, and their counts.

    Words are runs of letters, in lower case; an n-gram never spans two words.
    """
    empty = np.empty(0, np.int64)
    if not text:
        return empty, empty
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate([[EDGE], c, [EDGE]])
    c = c[(c != EDGE) | np.concatenate([[True], c[:-1] != EDGE])]  # one boundary between words
    if len(c) < 3:
        return empty, empty
    two = (c[:-1] << BITS) | c[1:]
    three = ((two[:-1] << BITS) | c[2:])[c[1:-1] != EDGE]
    return np.unique(np.concatenate([c[c != EDGE], two, three]), return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent, in order; ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:k]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, counts by (lang, gram)."""
    for b in batches:
        parts: dict[str, list] = {}
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parts.setdefault(lang, []).append(ngrams(text))
        for lang, found in parts.items():
            codes, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([x for _, x in found]), minlength=len(codes)).astype(np.int64)
            if len(codes):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"])


class Profiles:
    """Ranks of the n-grams of all profiles in one table."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.size, self.langs = size, sorted(ranked)
        self.codes = np.unique(np.concatenate([np.array(v, np.int64) for v in ranked.values()])) if ranked else np.empty(0, np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, ranked[lang]), j] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the nearest profile, and 1 less its distance as a share of the largest."""
        own = top(*ngrams(text), self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        ranks = self.ranks[at]
        out = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(own))[:, None]), self.size)).sum(0)
        best = int(out.argmin())
        return self.langs[best], 1 - float(out[best]) / (self.size * len(own))


def fit(documents: DataFrame, size: int = PROFILE, mod: int = 5) -> Profiles:
    """Learns from text and lang of rows with a lang whose crc32(doc_id as text) mod ``mod`` is not 0."""
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), mod, 0))
    counts = known.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(_count, "lang string, gram bigint, n bigint")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(64)))
    for keys in (("lang", "part"), ("lang",)):
        w = Window.partitionBy(*keys).orderBy(F.desc("n"), "gram")
        counts = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)
    ranked: dict[str, list[int]] = {}
    for r in counts.select("lang", "gram", "rank").orderBy("lang", "rank").toLocalIterator():  # size rows a language
        ranked.setdefault(r.lang, []).append(r.gram)
    return Profiles(ranked, size)


def identify(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.predict(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    out = documents.select(F.col("text").cast("string"), "doc_id").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


#: The share of the lowest score of a recognised text, among the learned documents, that is asked for.
FLOOR_SHARE = 0.5


def floor(documents: DataFrame, profiles: Profiles, mod: int = 5) -> float:
    """FLOOR_SHARE of the lowest score among all learned documents that are predicted as labelled; 0 without any.

    Text in a language that was not learned, random letters and dumps of digits score lower than the
    texts that the profiles come from.
    """
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), mod, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(profiles.predict(t), lang) for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([s for (x, s), lang in found if x == lang], pa.float64())], names=["score"])

    lowest = known.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, "score double").agg(F.min("score").alias("low")).first().low
    return FLOOR_SHARE * (lowest or 0.0)


def keep_identified(documents: DataFrame, profiles: Profiles, least: float = 0.0) -> DataFrame:
    """The rows of ``documents``, with all their columns, that have a language with a score of ``least`` (see ``floor``) or more."""
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.predict(t) for t in b.column(text).to_pylist()]
            yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in found], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
