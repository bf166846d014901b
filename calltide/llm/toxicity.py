"""Operator 9, toxicity: a counterfactually regularised classifier.

A logistic model over the distinct words of a whole text, their stems (the
first 4 and 5 letters of longer words), and the stems that several of its words share. Features are kept whose document
frequencies differ between the labels by a G statistic of LEAST_G or more.
For each learning document that has identity terms, one of its sentences gets
the terms swapped for others of their group; the squared change of the
sentence's score (as log odds) is part of the loss, so that naming a group does not move a
score. Sentences without such a term get one put in, against the same sentence
with another of the group, as long as fewer than MIN_PAIRS real swaps occur.

It is fitted on a bounded sample of labelled rows: per label the SAMPLE doc_ids
lowest by hash, each with one text (the lowest by hash, where rows that repeat the doc_id have several).
Everything else covers all rows. Words are gathered and counted in tasks; the driver receives the
kept features (FEATURES at most) and, for each learning row, the numbers of those it has, never a text.

Defined cases: a missing or empty text has no words and gets the score of the
intercept; rows are scored one by one, so repeated rows score alike; without
learning rows of both labels every score is the share of label 1 (0 without any
rows); a doc_id with contradicting labels is not learned from.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, held_out, written

#: Rows per label that are learned from, and features, at most.
SAMPLE = 5_000
FEATURES = 20_000
MIN_PAIRS = 400
#: Likelihood ratio statistic (chance level under 1e-5) from which on a feature is kept.
LEAST_G = 20.0
STEMS = (4, 5)
#: Identity terms by group (fixed values); the terms of a group replace each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "deaf", "blind", "elderly", "young"),
)
GROUP = {t: g for g in IDENTITY for t in g}
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def stemmed(own: set[str]) -> set[str]:
    """The words and, ending with a hyphen, their stems; with a plus those that two or more different words have."""
    out = set(own)
    for n in STEMS:
        shared = Counter([w[:n] for w in own if len(w) > n])
        out.update([x + "-" for x in shared], [x + "+" for x, times in shared.items() if times > 1])
    return out


def words(text: str | None) -> set[str]:
    return stemmed(set(WORD.findall((text or "").lower())))


def swapped(own: list[str], seed: int) -> list[str]:
    """The words with each identity term replaced by the next of its group (by ``seed``)."""
    return [g[(g.index(w) + 1 + seed % (len(g) - 1)) % len(g)] if (g := GROUP.get(w)) else w for w in own]


def counterpart(text: str | None, seed: int) -> tuple[bool, list[str], list[str]]:
    """Whether a sentence of the text names a group, and the features that it has and its counterpart with other terms has not, and the other way round."""
    rng = random.Random(seed)
    sentences = [WORD.findall(s) for s in SENTENCE.split((text or "").lower()) if s.strip()]
    named = [s for s in sentences if any(w in GROUP for w in s)]
    if named:
        s = rng.choice(named)
        a, b = set(s), set(swapped(s, rng.randrange(1 << 30)))
    else:
        s, (x, y) = rng.choice(sentences or [[]]), rng.sample(rng.choice(IDENTITY), 2)
        a, b = {*s, x}, {*s, y}
    a, b = stemmed(a), stemmed(b)
    return bool(named), sorted(a - b), sorted(b - a)


class Model:
    """Word weights and an intercept; words that are not in it weigh nothing."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, text: str | None) -> float:
        w = self.weights
        z = self.intercept + sum(sorted(w[x] for x in words(text) & w.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


class Learning(NamedTuple):
    """What is learned from: features by number; of each row the numbers it has and its label; of each pair those of either side; the odds of label 1 in all rows."""

    names: list[str]
    rows: list[np.ndarray]
    labels: list[int]
    pairs: list[tuple[np.ndarray, np.ndarray]]
    odds: float | None


def gradient(w: np.ndarray, bias: float, rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], swap: float, l2: float) -> tuple[np.ndarray, float]:
    """Of the mean log loss of the rows, ``swap`` times the mean squared change of the pairs, and ``l2`` / 2 times the squared weights."""
    flat, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    z = bias + np.bincount(row, weights=w[flat], minlength=len(rows))
    error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(rows)
    grad = np.bincount(flat, weights=error[row], minlength=len(w)) + l2 * w
    for a, b in pairs if swap else ():
        change = 2 * swap * (w[a].sum() - w[b].sum()) / len(pairs)
        grad[a] += change
        grad[b] -= change
    return grad, float(error.sum())


def train(data: Learning, swap: float = 1.0, l2: float = 1e-6, epochs: int = 30, rate: float = 0.5, batch: int = 256, seed: int = 7) -> Model:
    """AdaGrad over small batches; the intercept is moved to the odds in all learning rows."""
    y = np.array(data.labels, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros(len(data.names)), np.full(len(data.names), 1e-8)
    own = float(np.log(y.mean() / (1 - y.mean())))
    bias, b2 = own, 1e-8
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            some = [data.pairs[k] for k in rng.integers(len(data.pairs), size=32)] if data.pairs else []
            grad, step = gradient(w, bias, [data.rows[r] for r in rows], y[rows], some, swap, l2)
            g2 += grad**2
            w -= rate / np.sqrt(g2) * grad
            b2 += step**2
            bias -= rate / np.sqrt(b2) * step
    if data.odds:
        bias += float(np.log(data.odds)) - own
    return Model({data.names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3)}, bias)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features and the counterpart of each row."""
    for b in batches:
        found = [(sorted(words(t)), *counterpart(t, seed)) for t, seed in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)]
        texts = [pa.array([x[i] for x in found], pa.list_(pa.string())) for i in (0, 2, 3)]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x[1] for x in found], pa.bool_()), *texts], names=["doc_id", "label", "h", "named", "own", "here", "there"])


def learning(documents: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1, size: int = SAMPLE) -> Learning:
    """Gathers what is learned from: at most ``size`` doc_ids per label, lowest by hash."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), mod, rest))
        .groupBy("doc_id").agg(F.min("toxic").cast("int").alias("label"), F.max("toxic").alias("other"))
        .where("label = other").select(F.col("doc_id").cast("bigint").alias("doc_id"), "label", F.xxhash64("doc_id").alias("h"))
    )
    n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy("h", "doc_id").limit(size)
        picked = part if picked is None else picked.unionByName(part)
    picked = written(picked, "picked")  # at most 2 * size rows
    texts = documents.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id")).where("text is not null").withColumn("t", F.xxhash64("text"))
    one = written(texts.select("doc_id", "t").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label", "h").agg(F.min("t").alias("t")), "picked")
    found = texts.join(F.broadcast(one), ["doc_id", "t"]).select("text", "doc_id", "label", "h")
    gathered = found.mapInArrow(_gathered, "doc_id bigint, label int, h bigint, named boolean, own array<string>, here array<string>, there array<string>")
    rows = written(gathered.dropDuplicates(["doc_id"]), "learning")

    seen = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    counts = rows.select("label", F.explode("own").alias("name")).groupBy("name").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    kept = counts.withColumn("g", _g(seen.get(1, 0), seen.get(0, 0))).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "name").limit(FEATURES)
    named = rows.select(F.explode(F.concat("here", "there")).alias("name")).distinct()  # identity terms and their stems
    names = sorted({r.name for r in kept.select("name").collect()} | {r.name for r in named.collect()})
    index = {x: i for i, x in enumerate(names)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [pa.array([np.array([index[x] for x in own if x in index], "<i4").tobytes() for own in b.column(i).to_pylist()], pa.binary()) for i in (3, 4, 5)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *lists], names=["label", "h", "named", "own", "here", "there"])

    found = rows.select("label", "h", "named", "own", "here", "there").mapInArrow(numbered, "label int, h bigint, named boolean, own binary, here binary, there binary")
    t = found.toArrow().sort_by([("h", "ascending"), ("label", "ascending")])
    drop_written(rows)
    own, here, there = ([np.frombuffer(x, "<i4").astype(np.int64) for x in t.column(c).to_pylist()] for c in ("own", "here", "there"))
    is_named = t.column("named").to_pylist()
    pairs = [(here[i], there[i]) for i, x in enumerate(is_named) if x]
    pairs += [(here[i], there[i]) for i, x in enumerate(is_named) if not x][: max(0, MIN_PAIRS - len(pairs))]
    return Learning(names, own, t.column("label").to_pylist(), pairs, n[1] / n[0] if len(n) == 2 else None)


def _g(n1: int, n0: int) -> Column:
    """The G statistic of a feature that a of n1 toxic and b of n0 other rows have."""
    a, b, n1, n0 = F.col("a"), F.col("b"), F.lit(float(n1)), F.lit(float(n0))
    share = (a + b) / (n1 + n0)
    term = lambda seen, expected: F.when((seen > 0) & (expected > 0), seen * F.log(seen / expected)).otherwise(0.0)
    return 2 * (term(a, n1 * share) + term(b, n0 * share) + term(n1 - a, n1 * (1 - share)) + term(n0 - b, n0 * (1 - share)))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    return train(learning(documents, labels))


def classify(documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    out = documents.select(F.col("text").cast("string"), "doc_id").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
