"""Operator 1, quality classifier: regularised quadratic discriminant analysis.

Each document becomes a vector of transformed statistics of its whole text.
Per class, mean and covariance come from sums over all labelled learning rows
(no sample); a class covariance is shrunk towards the pooled one and that
towards a multiple of the identity. A score is the logistic of the difference
of the two log densities (Mahalanobis distance and log determinant from the
Cholesky factor, which is computed once) plus the log prior odds.

Defined cases: a missing or empty text has the statistics of no words and gets
a score like any other; repeated rows are scored alike; with no learning rows
of one class every score is the share of label 1 (0.5 without any rows); where the learning rows
don't vary, both classes have the same density there and the prior decides; a
doc_id whose labels contradict each other is not learned from, repeated equal
labels count once; labels without a document and documents without a label
only drop out of learning.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, written

#: Bytes counted as symbols and as sentence punctuation (fixed values).
SYMBOLS = b"!#$%&*<>{}[]\\^~=+@_"
PUNCTUATION = b".,;:?"
N_FEATURES = 13
#: Least variance of a statistic, and of any direction of the standardised ones.
FLOOR = 1e-4
PRODUCTS = [(i, j) for i in range(N_FEATURES) for j in range(i + 1)]


def _classes() -> np.ndarray:
    """For each byte value, its class: 0 other, 1 upper, 2 symbol, 3 punctuation, 4 digit, 5 bar, 6 white space, 7 non-ASCII lead, 8 lower."""
    c = np.zeros(256, np.int64)
    c[65:91], c[97:123], c[48:58], c[192:] = 1, 8, 4, 7
    c[list(SYMBOLS)], c[list(PUNCTUATION)], c[ord("|")], c[[9, 10, 11, 12, 13, 32]] = 2, 3, 5, 6
    return c


BYTE_CLASS = _classes()


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    k = np.bincount(BYTE_CLASS, weights=np.bincount(raw, minlength=256), minlength=9)
    words = text.split()
    n, nw = len(raw), len(words)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    again = sum(map(eq, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    twice = len(lines) - len(set(lines))
    letters = k[1] + k[7] + k[8]
    share = lambda part, whole: np.log((part + 0.5) / (whole + 10.0))
    return [
        np.log1p(nw),
        np.log1p(letters / max(nw, 1)),
        share(k[1], letters),
        share(k[2], n),
        share(k[3], n),
        share(k[4], n),
        share(k[5], n),
        share(k[7], n),
        np.log((len(counts) + 1.0) / (nw + 1.0)),
        share(again, nw),
        np.log((top + 1.0) / (nw + 2.0)),
        share(twice, len(lines)),
        share(len(lines), nw),
    ]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [statistics(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(x, pa.list_(pa.float64()))], names=[*b.schema.names[1:], "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and class the sums of 1, x and its products, as rows (label, pos, value)."""
    rows, cols = np.array(PRODUCTS).T
    for b in batches:
        if not b.num_rows:
            continue
        y = b.column(0).to_numpy(zero_copy_only=False)
        x = np.array(b.column(1).to_pylist()).reshape(-1, N_FEATURES)
        for label in np.unique(y):
            z = x[y == label]
            sums = np.concatenate([[len(z)], z.sum(0), (z.T @ z)[rows, cols]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), label, np.int32)), pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["label", "pos", "value"])


class Model:
    """Means, cached inverse Cholesky factors and log determinants of the two classes."""

    def __init__(self, sums: dict[tuple[int, int], float], to_pooled: float, to_identity: float):
        n = {c: sums.get((c, 0), 0.0) for c in (0, 1)}
        total = n[0] + n[1]
        self.constant = None
        if min(n.values()) < 2:
            self.constant = n[1] / total if total else 0.5
            return
        mean, scatter = {}, {}
        for c in (0, 1):
            mean[c] = np.array([sums[c, 1 + i] for i in range(N_FEATURES)]) / n[c]
            s = np.zeros((N_FEATURES, N_FEATURES))
            for p, (i, j) in enumerate(PRODUCTS):
                s[i, j] = s[j, i] = sums[c, 1 + N_FEATURES + p]
            scatter[c] = s - n[c] * np.outer(mean[c], mean[c])
        pooled = (scatter[0] + scatter[1]) / total
        scale = np.sqrt(np.maximum(np.diag(pooled), FLOOR))  # the identity is that of standardised statistics
        self.parts = []
        for c in (0, 1):
            cov = (1 - to_pooled) * scatter[c] / n[c] + to_pooled * pooled
            cov = cov / np.outer(scale, scale)
            cov = (1 - to_identity) * cov + to_identity * np.trace(cov) / N_FEATURES * np.eye(N_FEATURES)
            # the floor keeps a factor where nothing varies, as with learning texts that are all empty
            spread, axes = np.linalg.eigh(cov)
            cov = (axes * np.maximum(spread, FLOOR)) @ axes.T
            factor = np.linalg.cholesky(cov)
            self.parts.append((mean[c], np.linalg.inv(factor) / scale, np.log(np.diag(factor)).sum()))
        self.prior = np.log(n[1] / n[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - d for m, f, d in self.parts]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -50, 50)))


def vectors(documents: DataFrame) -> DataFrame:
    """(doc_id, x) for each row of ``documents``."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select(F.col("text").cast("string").alias("text"), "doc_id").mapInArrow(_vectors, f"doc_id {kind}, x array<double>")


def fit(vectors: DataFrame, labels: DataFrame, to_pooled: float = 0.1, to_identity: float = 0.02, mod: int = 5) -> Model:
    """Learns from rows whose crc32(doc_id as text) mod ``mod`` is not 0."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), mod, 0))
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("other"))
        .where("label = other").select("doc_id", "label")
    )
    sums = vectors.join(known, "doc_id").select("label", "x").mapInArrow(_moments, "label int, pos int, value double")
    return Model({(r.label, r.pos): r.value for r in sums.groupBy("label", "pos").agg(F.sum("value").alias("value")).collect()}, to_pooled, to_identity)


def scored(vectors: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) from ``vectors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    kind = vectors.schema["doc_id"].dataType.simpleString()
    out = vectors.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Scores every document; the vectors (narrow) are computed once and written, the texts are read once."""
    x = written(vectors(documents), "quality")
    return scored(x, fit(x, labels), threshold)


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose predicted label is 1."""
    x = written(vectors(documents), "quality")
    model = fit(x, labels)
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array([statistics(t) for t in b.column(text).to_pylist()], float).reshape(-1, N_FEATURES)
            yield b.filter(pa.array(model.score(v) >= threshold))

    return documents.mapInArrow(run, documents.schema)
