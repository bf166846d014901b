"""Operator 2, benchmark decontamination by the CGK embedding.

A passage of a document leaks an item of L words if some run of its words has
an edit distance (on words) to the item of at most ``floor(L / 5)``, that is a
similarity of 0.8 or more.

The CGK random walk embeds items and windows of their size: it writes the word
it stands on and goes on, or stays, as a hash of the walk, the step and the word
says, so that edit distance becomes Hamming distance. Bit sampling LSH hashes
POSITIONS sampled steps of a walk into a bucket, in as many repetitions as the
target recall needs; there are WALKS independent walks for them. The share of
equal steps that random edits of the items themselves leave, at the most edits allowed, gives the
number of repetitions for each length. The buckets of the items are the source of
candidates: each window is looked up in the buckets of its length, and what it meets there is
verified: the edit distance of the item to any run of words around the window, exactly.

Which windows are embedded at all is told by a prefilter that loses none: a
passage within d edits of L words holds, unchanged, one of the item's runs of
``ceil((L - d) / (d + 1))`` words (the pigeonhole principle). So windows of L
words are laid only where such a run of any item of L words stands, at
the place in the window that it has in the item.

Each document is looked at on its own, against the items in blocks bounded in
items and characters, so nothing is shuffled but the (rare) leaks. Only bucket
keys of a block are kept, not embeddings; these are made for a bounded number of windows at a time.

Defined cases: words are runs, in lower case, of letters, digits and whatever is not ASCII; items
without words leak nowhere; missing and empty texts leak nothing; an item with
fewer than five words must occur exactly; repeated items count each under its
id; rows that repeat a document give one row per (doc_id, item_id), the closest;
a missing item_id or doc_id is reported as such.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: ASCII signs part words as white space does.
SPACES = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))
#: Items, and characters of them, that are held at once, about.
BLOCK, BLOCK_CHARS = 20_000, 8 << 20
RECALL = 0.99
WALKS, POSITIONS = 32, 2
#: Steps that are sampled, for each word of the window; hardly a walk ends before.
REACH = 1.8
#: Steps of embeddings, and bucket keys, that are held at once.
STEPS, KEYS = 4 << 20, 1 << 20
END = np.uint64(0)
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(SPACES).split()


def word_hashes(text: str | None) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = (out * _ODD) ^ h[i : len(h) - n + 1 + i]
        out ^= out >> np.uint64(29)
    return out


def distance_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the item to any run of the words of ``text``, and where the best run ends (bit-parallel)."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    m = len(item)
    high, full = 1 << (m - 1), (1 << m) - 1
    up, down, score = full, 0, m
    best = (m, 0)
    for j, w in enumerate(text.tolist()):
        eq = masks.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = (down | ~(xh | up)) & full
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up = (mh | ~(xv | ph)) & full
        down = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


class Items:
    """A block of items: their words, the runs that mark windows, and the buckets of their embeddings."""

    def __init__(self, ids: list[int | None], texts: list[str | None], recall: float = RECALL, seed: int = 11):
        found = [(i, h) for i, t in zip(ids, texts, strict=True) if len(h := word_hashes(t))]
        self.ids, self.words = [i for i, _ in found], [h for _, h in found]
        self.size = np.array([len(h) for h in self.words], np.int64)
        self.most = self.size // 5
        runs: dict[int, list[np.ndarray]] = {}
        for h, d in zip(self.words, self.most, strict=True):
            n = -(-(len(h) - int(d)) // (int(d) + 1))
            r = run_hashes(h, n)
            runs.setdefault(n, []).append(np.stack([r, np.full(len(r), len(h), np.uint64), np.arange(len(r), dtype=np.uint64)]))
        self.runs = {}
        for n, parts in runs.items():
            r, size, at = np.unique(np.concatenate(parts, axis=1), axis=1)  # sorted by r
            maybe = np.zeros(1 << 20, bool)
            maybe[(r >> np.uint64(44)).astype(np.int64)] = True
            self.runs[n] = (r, size.astype(np.int64), at.astype(np.int64), maybe)
        self.positions, self.buckets = {}, {}
        for size in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == size)
            flat, start = np.concatenate([self.words[k] for k in own]), np.arange(len(own)) * size
            rng = np.random.default_rng((seed, size))
            steps = max(1, int(REACH * size))
            self.positions[size] = np.sort(rng.integers(steps, size=(self.repeats(flat, size, rng, recall), POSITIONS)), axis=1)
            keys, item = [], []
            for at, k in self.keys(size, flat, start, start + size):
                keys.append(k.ravel())
                item.append(np.tile(own[at : at + k.shape[1]], len(k)))
            keys, item = np.concatenate(keys), np.concatenate(item)
            order = np.argsort(keys, kind="stable")
            order = order[keys[order] != END]
            self.buckets[size] = (keys[order], item[order].astype(np.int32))

    @staticmethod
    def walk(steps: int, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The embeddings, by walk and step, of the windows from ``start`` to ``end``."""
        seeds = (np.arange(WALKS, dtype=np.uint64)[:, None] + np.uint64(1)) * _MIX
        out = np.zeros((WALKS, steps, len(start)), np.uint64)
        at = np.tile(start, (WALKS, 1))
        for j in range(steps):
            live = at < end
            x = np.where(live, h[np.minimum(at, len(h) - 1)], END)
            out[:, j] = x
            turn = (x ^ seeds ^ np.uint64((j + 1) * int(_ODD) % (1 << 64))) * _MIX
            turn ^= turn >> np.uint64(32)
            at += (((turn * _ODD) >> np.uint64(63)).astype(np.int64)) * live
        return out

    def repeats(self, flat: np.ndarray, size: int, rng: np.random.Generator, recall: float, tries: int = 24) -> int:
        """Repetitions for the recall, from the share of sampled steps that stay equal under the most edits allowed (the lower tenth over items)."""
        steps, texts = max(1, int(REACH * size)), []
        picked = rng.integers(len(flat) // size, size=tries)
        for k in picked:
            w, d = flat[k * size : (k + 1) * size].tolist(), size // 5
            for _ in range(d):
                at, kind = int(rng.integers(len(w))), int(rng.integers(3))
                w[at : at + (kind != 0)] = [] if kind == 1 else [int(rng.integers(1 << 62))]
            texts.append(np.array((w + rng.integers(1 << 62, size=size).tolist())[:size], np.uint64))
        start = np.arange(tries) * size
        shares = []
        for some in range(0, tries, max(1, STEPS // (WALKS * steps))):
            part = slice(some, some + max(1, STEPS // (WALKS * steps)))
            a = self.walk(steps, np.concatenate(texts), start[part], start[part] + size)
            b = self.walk(steps, flat, picked[part] * size, picked[part] * size + size)
            shares.append(((a == b) & (a != END)).mean(axis=(0, 1)))
        equal = max(0.5 / steps, float(np.quantile(np.concatenate(shares), 0.1))) ** POSITIONS
        return WALKS if equal >= 1 else max(WALKS, int(np.ceil(np.log(1 - recall) / np.log1p(-equal))))

    def keys(self, size: int, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For bounded parts of the windows: where the part begins, and bucket keys by repetition and window; END where a walk had ended."""
        pos = self.positions[size]
        steps, own = int(pos.max()) + 1, np.arange(len(pos)) % WALKS
        n = max(1, min(STEPS // (WALKS * steps), KEYS // len(pos)))
        for at in range(0, len(start), n):
            words = self.walk(steps, h, start[at : at + n], end[at : at + n])
            key = np.arange(1, len(pos) + 1, dtype=np.uint64)[:, None] * _ODD
            key, whole = np.repeat(key, words.shape[2], axis=1), True
            for p in range(POSITIONS):
                x = words[own, pos[:, p]]
                whole = whole & (x != END)
                key = (key ^ x) * _MIX
                key ^= key >> np.uint64(29)
            yield at, np.where(whole, np.maximum(key, np.uint64(1)), END)

    def windows(self, docs: list[np.ndarray], h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(size, document, start) of the windows where an item of that size may leak."""
        found = [np.empty((3, 0), np.int64)]
        for n, (runs, size, offset, maybe) in self.runs.items():
            r = run_hashes(h, n)
            at = np.flatnonzero(maybe[(r >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(runs, r[at], "left"), np.searchsorted(runs, r[at], "right")
            hit = high > low
            at, low, n_hits = at[hit], low[hit], (high - low)[hit]
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + n <= first[doc + 1]  # a run doesn't span documents
            at, low, n_hits, doc = at[inside], low[inside], n_hits[inside], doc[inside]
            many = np.repeat(np.arange(len(at)), n_hits)
            e = low[many] + np.arange(len(many)) - np.repeat(np.cumsum(n_hits) - n_hits, n_hits)
            found.append(np.stack([size[e], doc[many], np.maximum(at[many] - offset[e], first[doc[many]])]))
        return np.unique(np.concatenate(found, axis=1), axis=1)

    def leaks(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(document, item, distance, start word) of each leak in a batch, the closest for each pair."""
        if not self.ids:
            return []
        first = np.concatenate([[0], np.cumsum([len(h) for h in docs])]).astype(np.int64)
        h = np.concatenate([*docs, np.empty(0, np.uint64)])
        sizes, doc, start = self.windows(docs, h, first)
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            buckets, item = self.buckets[size]
            for at, keys in self.keys(size, h, start[own], np.minimum(start[own] + size, first[doc[own] + 1])):
                low, high = np.searchsorted(buckets, keys.ravel(), "left"), np.searchsorted(buckets, keys.ravel(), "right")
                n_hits = high - low  # END is in no bucket
                many = np.repeat(np.arange(len(low)), n_hits)
                e = low[many] + np.arange(len(many)) - np.repeat(np.cumsum(n_hits) - n_hits, n_hits)
                met = np.unique(np.stack([own[at + many % keys.shape[1]], item[e].astype(np.int64)]), axis=1)
                for w, k in met.T.tolist():
                    self._verify(docs, int(doc[w]), k, int(start[w] - first[doc[w]]), out)
        return [(d, k, *v) for (d, k), v in out.items()]

    def _verify(self, docs: list[np.ndarray], d: int, k: int, start: int, out: dict[tuple[int, int], tuple[int, int]]) -> None:
        """Adds the pair if the item is close enough to some run of words around the window; the closest place stays."""
        if out.get((d, k), (1,))[0] == 0:
            return
        most, n = int(self.most[k]), int(self.size[k])
        low = max(0, start - most)
        dist, end = distance_within(self.words[k], docs[d][low : start + n + most])
        place = max(0, low + end - n)
        if dist <= most and (dist, place) < out.get((d, k), (most + 1, 0)):
            out[d, k] = (dist, place)


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks (by hash of item_id and text), so that no more is held or sent at once."""
    own = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n = max(1, -(-size.n // (BLOCK // 2)), -(-size.chars // (BLOCK_CHARS // 2)))
    for part in range(n):
        t = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == part).orderBy("item_id", "text").toArrow()
        yield Items(t.column("item_id").to_pylist(), t.column("text").to_pylist())


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, item_words, similarity, start_word), one row per document and leaked item."""
    texts = documents.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))
    schema = "doc_id bigint, item_id bigint, distance bigint, item_words bigint, start_word bigint"
    out = None
    for items in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    some = b.slice(at, 1000)
                    found = items.leaks([word_hashes(t) for t in some.column(0).to_pylist()])
                    doc = some.column(1).take(pa.array([x[0] for x in found], pa.int64()))
                    rest = [[items.ids[x[1]] for x in found], [x[2] for x in found], [int(items.size[x[1]]) for x in found], [x[3] for x in found]]
                    yield pa.RecordBatch.from_arrays([doc, *(pa.array(x, pa.int64()) for x in rest)], names=["doc_id", "item_id", "distance", "item_words", "start_word"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    closest = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "item_words", "start_word")).alias("m"))
    return closest.select("doc_id", "item_id", "m.distance", "m.item_words", (1 - F.col("m.distance") / F.col("m.item_words")).alias("similarity"), "m.start_word")


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents``, with all their columns, in which no item leaks; each is judged where it is, nothing is shuffled.

    What is left after a block of items is written before the next, so that a task has one Python worker and holds one block.
    """
    text, own, out = documents.columns.index("text"), [], None
    for items in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    some = b.slice(at, 1000)
                    gone = {x[0] for x in items.leaks([word_hashes(t) for t in some.column(text).to_pylist()])}
                    yield some.filter(pa.array([i not in gone for i in range(some.num_rows)], pa.bool_()))

        if out is not None:
            documents = written(out, "clean")
            drop_written(*own)
            own = [documents]
        out = documents.mapInArrow(run, documents.schema)
    return out
