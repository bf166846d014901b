"""Operator 7, packing by minimum bin slack.

A document's ids are cut into full windows and one remaining piece. Windows
for the remaining pieces are filled one pattern at a time: the longest piece
left, and the multiset of other lengths left that comes closest to the room
beside it, found by subset sums over bitsets (lengths in order of their
counts) and read off by backtracking. A pattern is used as often as its
lengths last. Only the histogram of lengths (less than ``capacity`` rows)
is seen by the driver, so the plan costs the same for any number of documents;
each piece finds its window from its rank among the pieces of its length.

Defined cases: a missing or empty text holds the end id only; repeated rows are
packed each for itself; an empty table gives no pieces; all windows but those of the last patterns are full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder

CAPACITY = 1024
END = 0


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """A multiset of lengths, within their counts, whose sum is as close to ``room`` as any."""
    full, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, key=lambda x: (-counts[x], x)):
        most, step, before = min(counts[length], room // length), 1, reach
        if not most:
            continue
        while most:  # binary parts of the count
            step = min(step, most)
            reach |= (reach << (length * step)) & full
            most -= step
            step *= 2
        layers.append((length, before))
        if reach >> room & 1:
            break
    target, out = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        n = 0
        while not before >> target & 1:
            target -= length
            n += 1
        if n:
            out[length] = n
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns: how often, and the (length, count) that make up the window, longest first."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        others = dict(left)
        others[longest] -= 1
        own = fill({k: v for k, v in others.items() if v}, capacity - longest)
        own[longest] = own.get(longest, 0) + 1
        times = min(left[k] // n for k, n in own.items())
        out.append((times, sorted(own.items(), reverse=True)))
        for k, n in own.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return out


class Slots:
    """For a length and rank, the window and the offset in it. Windows are numbered from ``first``."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]], first: int):
        taken: dict[int, int] = {}
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        for times, own in patterns:
            at = 0
            for length, n in own:
                low = taken.get(length, 0)
                rows.setdefault(length, []).append((low, n, first, at))
                taken[length] = low + times * n
                at += length * n
            first += times
        self.rows = {k: np.array(v, np.int64).T for k, v in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        window, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length):
            own = length == k
            low, n, first, at = self.rows[int(k)]
            i = np.searchsorted(low, rank[own], side="right") - 1
            past = rank[own] - low[i]
            window[own], offset[own] = first[i] + past // n[i], at[i] + past % n[i] * k
        return window, offset


def pieces(documents: DataFrame, tokenizer: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, rank): rank counts the pieces of that length in the task."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, ids_of = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(tokenizer).encode
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                some, rows = b.slice(at, 2000), []
                for k, text in enumerate(some.column(0).to_pylist()):
                    ids = ids_of(text) + last
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        rows.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, seen[length]))
                        seen[length] += 1
                x = np.array(rows, np.int64).reshape(-1, 6).T
                yield pa.RecordBatch.from_arrays([some.column(1).take(pa.array(x[0])), *map(pa.array, x[1:5]), pa.array(np.full(x.shape[1], part, np.int32)), pa.array(x[5])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])

    texts = documents.select(F.col("text").cast("string").alias("text"), "doc_id")
    return texts.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, rank bigint")


def pack(documents: DataFrame, tokenizer: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece."""
    cut = written(pieces(documents, tokenizer, end, capacity), "pieces")
    groups = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    firsts = groups.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("first"))
    counts = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    whole = counts.pop(capacity, 0)
    slots = Slots(([(whole, [(capacity, 1)])] if whole else []) + plan(counts, capacity), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            window, offset = slots.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(window), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    ranked = cut.join(firsts, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
