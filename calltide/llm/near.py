"""Operator 6, near duplicates by MinHash and a multi-index Hamming join.

A document's set is that of its distinct shingles of five words. Its signature
has SYMBOLS minimum hashes of 16 bits each. Two signatures that differ in at
most ``radius`` symbols have, by the pigeonhole principle, one of ``chunks`` chunks
with at most ``radius // chunks`` (here 1) different symbols; so each chunk is
indexed once for each choice of that many symbols left out, and all pairs
within the radius share an index key. Radius and chunks belong to the least
similarity (``Scheme``): 0.85 as the query's contract says, 0.8 in the pipeline.

Documents with equal sets become one node before anything is shuffled. Nodes
that share a key are tied into stars (in each batch first, so that a key of
any number of documents sends one row per batch), and the components of the
stars are the only clusters that can hold links. Clusters are cut into tiles
of bounded size. In a tile the signatures say which nodes have another one within the radius; only
their texts are read again, and the pairs within the radius compared on their full
sets, nearest first, skipping pairs that are already connected, so that a tile
yields at most a spanning forest of confirmed links. For clusters of several tiles the first
tile is compared with each other one, and then the nodes outside the largest
component that came of that with all nodes.

Defined cases: a missing text, or one without words, has no shingles and is
linked with nothing; with fewer than five words the whole sequence is the one
shingle; exact copies and repeated rows are linked; rows without a doc_id are
linked with nothing and kept; in ``components`` rows that repeat a doc_id are one document, which
is linked with whatever any of its texts is linked with; ``keep_one`` judges each (doc_id, text) for
itself and keeps a repeated row once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, min_label_components, sieve, stars, written

WORDS = 5
SYMBOLS = 64
#: Nodes and shingles of a tile, about.
TILE, TILE_SHINGLES = 512, 1 << 20


class Scheme(NamedTuple):
    """The least similarity, in hundredths, and the radius and chunks of the signatures that find it."""

    share: int
    radius: int
    chunks: int


#: A pair at the least similarity is further apart than the radius with a chance of about 1e-5 (0.85) or 1e-3 (0.8; 1e-4 at 0.82). A wider
#: radius needs keys of so few symbols that texts with a common passage make clusters whose comparisons grow with their square.
LINKS_85, LINKS_80 = Scheme(85, 23, 12), Scheme(80, 23, 12)

_rng = np.random.default_rng(20_240_101)
_MULTIPLY = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None) -> np.ndarray:
    """The set of a whole text as ascending 64-bit hashes."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # lower-cases A-Z; splits at x20 and x09-x0D
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = min(len(h), WORDS)
    out = h[: len(h) - n + 1] ^ np.uint64(n)
    for i in range(1, n):
        out = (out * _ODD) ^ h[i : len(h) - n + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(own: np.ndarray) -> np.ndarray:
    """SYMBOLS minimum hashes, 16 bits of each."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        x = own[None, at : at + 4096] * _MULTIPLY[:, None]
        x ^= x >> np.uint64(32)
        x *= _MIX
        low = np.minimum(low, x.min(1))
    return (low >> np.uint64(48)).astype(np.uint16)


@cache
def index_columns(radius: int, chunks: int, symbols: int = SYMBOLS) -> list[tuple[int, ...]]:
    """The symbols of each index: each chunk less each choice of as many symbols as may differ in it."""
    ends, errors = np.linspace(0, symbols, chunks + 1).astype(int), radius // chunks
    return [tuple(c for c in range(a, b) if c not in left_out) for a, b in zip(ends[:-1], ends[1:], strict=True) for left_out in combinations(range(a, b), errors)]


def keys(signatures: np.ndarray, scheme: Scheme) -> np.ndarray:
    """A key for each signature (row) and index (column)."""
    indexes = index_columns(scheme.radius, scheme.chunks)
    out = np.empty((len(signatures), len(indexes)), np.uint64)
    for i, cols in enumerate(indexes):
        h = np.full(len(signatures), np.uint64((i + 1) * int(_ODD) % (1 << 64)))
        for c in cols:
            h = (h ^ signatures[:, c]) * _MIX
            h ^= h >> np.uint64(31)
        out[:, i] = h
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node, n, sig = [], [], []
        for own in map(shingles, b.column(0).to_pylist()):
            n.append(len(own))
            node.append(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) if len(own) else None)
            sig.append(signature(own).tobytes() if len(own) else None)
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "h", "node", "n_shingles", "sig"])


def _by_key(batches: Iterator[pa.RecordBatch], scheme: Scheme, edges: bool) -> Iterator[pa.RecordBatch]:
    """Of each batch: the smallest node of each key, or edges from the other nodes of a key to it."""
    for b in batches:
        node, first = np.unique(b.column(0).to_numpy(), return_index=True)
        if not len(node):
            continue
        sig = np.frombuffer(b"".join(b.column(1).take(pa.array(first)).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        k = keys(sig, scheme)
        k, owner = k.ravel(), np.repeat(np.arange(len(node)), k.shape[1])
        order = np.argsort(k, kind="stable")  # nodes ascend, so the smallest of a key is its first
        k, owner = k[order], owner[order]
        head = np.concatenate([[True], k[1:] != k[:-1]])
        low = owner[head][np.cumsum(head) - 1]
        if edges:
            pair = np.unique(np.stack([owner, low])[:, owner != low], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(node[pair[0]]), pa.array(node[pair[1]])], names=["a", "b"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(k[head].view(np.int64)), pa.array(node[owner[head]])], names=["key", "node"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets and signatures of the nodes that may be linked; rows whose text is not that of the node drop out."""
    for b in batches:
        rows, own_sets, sigs = [], [], []
        for i, (text, node) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            own = shingles(text)
            if len(own) and xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) == node:
                rows.append(i)
                own_sets.append(own.tobytes())
                sigs.append(signature(own).tobytes())
        some = b.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(own_sets, pa.binary()), pa.array(sigs, pa.binary())], names=[*b.schema.names[1:], "own", "sig"])


def _within(scheme: Scheme, comp: np.ndarray, side: np.ndarray, size: np.ndarray, m: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each node of side 1 the nodes (and distances) within the radius that ``comp`` does not connect with it and whose sets are not too small or large; pairs of side 1 once."""
    for i in np.flatnonzero(side):
        js = np.flatnonzero((comp != comp[i]) & ((side == 0) | (np.arange(len(comp)) > i)))
        js = js[(100 * np.minimum(size[js], size[i]) >= scheme.share * np.maximum(size[js], size[i]))]
        far = (m[js] != m[i]).sum(1)
        yield int(i), js[far <= scheme.radius], far[far <= scheme.radius]


def _symbols(sig: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sig), np.uint16).reshape(-1, SYMBOLS)


def _links(t: pa.Table, scheme: Scheme) -> pa.RecordBatch:
    """Confirmed links of a tile (node, comp, side, own, sig) that connect what ``comp`` does not, as many as it takes; with two sides only between side 1 and any."""
    node, first = np.unique(t.column("node").to_numpy(), return_index=True)
    t = t.take(pa.array(first))
    comp, side, sets = t.column("comp").to_numpy(), t.column("side").to_numpy(), [np.frombuffer(x, np.uint64) for x in t.column("own").to_pylist()]
    root = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    found, out = [], []
    for i, js, far in _within(scheme, comp, side, np.array([len(s) for s in sets]), _symbols(t.column("sig").to_pylist())):
        found += [(int(d), i, int(j)) for d, j in zip(far, js, strict=True)]
    for _, i, j in sorted(found):
        x, y = find(int(comp[i])), find(int(comp[j]))
        if x != y:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= scheme.share * (len(sets[i]) + len(sets[j]) - both):
                root[max(x, y)] = min(x, y)
                out.append((int(node[i]), int(node[j])))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])


def _near(t: pa.Table, scheme: Scheme) -> pa.RecordBatch:
    """The nodes of a tile (tile, node, comp, side, size, sig) that have another one within the radius, by their signatures alone."""
    comp, side, size = (t.column(c).to_numpy() for c in ("comp", "side", "size"))
    some = np.zeros(len(comp), bool)
    for i, js, _ in _within(scheme, comp, side, size, _symbols(t.column("sig").to_pylist())):
        some[js] = True
        some[i] |= len(js) > 0
    return t.select(["tile", "node", "comp", "side"]).filter(pa.array(some)).combine_chunks().to_batches()[0] if some.any() else pa.RecordBatch.from_pylist([], t.select(["tile", "node", "comp", "side"]).schema)


def _tiles(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table, Scheme], pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """``work`` on each tile; the rows come sorted by tile, which is the first column; a tile at a time is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        tile = b.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else []
        for x, y in zip(starts, [*starts[1:], len(tile)], strict=True):
            if held and tile[x] != last:
                yield work(pa.Table.from_batches(held), scheme)
                held.clear()
            last = tile[x]
            held.append(b.slice(x, y - x))
    if held:
        yield work(pa.Table.from_batches(held), scheme)


def _by_tile(rows: DataFrame, work: Callable[[pa.Table, Scheme], pa.RecordBatch], scheme: Scheme, schema: str) -> DataFrame:
    """Runs ``work`` on the rows of each tile: they stay together, in memory one tile at a time."""
    dealt = rows.repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(lambda batches: _tiles(batches, work, scheme), schema)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id")).withColumn("h", F.xxhash64("text"))


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, h, node, n_shingles, sig) of each row: h hashes the text, node its set of shingles."""
    return written(_texts(documents).mapInArrow(_features, "doc_id bigint, h bigint, node bigint, n_shingles bigint, sig binary"), "shingles")


def nodes_of(feats: DataFrame) -> DataFrame:
    """(node, first, shingles, sig, n): each distinct set, with the smallest (doc_id, h) that has it and the number of rows."""
    real = feats.where("node is not null and doc_id is not null")
    return written(real.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.max("n_shingles").alias("shingles"), F.max("sig").alias("sig"), F.count("*").alias("n")), "nodes")


def _sets_of(documents: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, own, sig) of the wanted nodes, from the text of the first row that has the set."""
    named = written(members.select("node", "doc_id", "h").join(wanted.select("node").distinct().hint("merge"), "node"), "wanted")
    # a sieve of fixed size keeps most texts from the shuffle; what is wanted grows with the input, so it is not sent to the texts
    texts = sieve(_texts(documents), named, ["doc_id", "h"]).where("maybe").drop("maybe").dropDuplicates(["doc_id", "h"])
    found = texts.join(named.hint("merge"), ["doc_id", "h"]).select("text", "node")
    return written(found.mapInArrow(_sets, "node bigint, own binary, sig binary"), "sets")


def links(documents: DataFrame, feats: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b): confirmed links between nodes, as many as it takes to connect what is connected."""
    sigs = feats.where("node is not null and doc_id is not null").select("node", "sig")
    # stars of nodes that share a key: in each batch, then over the batches. A batch sends one row for a key, so
    # even a key that all nodes share is less than one row in a thousand of those that are dealt out
    inside = sigs.mapInArrow(lambda batches: stars(_by_key(batches, scheme, True)), "u bigint, v bigint")
    low = sigs.mapInArrow(lambda batches: _by_key(batches, scheme, False), "key bigint, node bigint").withColumn("low", F.min("node").over(Window.partitionBy("key")))
    far = low.where("node <> low").select("node", "low").mapInArrow(stars, "u bigint, v bigint")
    clusters = min_label_components(inside.unionByName(far), "u", "v", tied=True).withColumnRenamed("component", "cluster")

    members = clusters.join(nodes.drop("n").hint("merge"), "node")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("shingles") / TILE_SHINGLES)).cast("long").alias("tiles"), F.count("*").alias("n"))
    named, sizes = written(members.select("node", "cluster", "sig", F.col("shingles").alias("size"), "first.doc_id", "first.h"), "members"), written(sizes, "sizes")
    members = lookup(named, sizes, ["cluster"], named.count()).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles"))
    near_rows, link_rows = "tile bigint, node bigint, comp bigint, side int", "a bigint, b bigint"

    # the first tile with each of the others, by signatures; only nodes with another one within the radius are read again
    others = F.when(F.col("tile") > 0, F.array("tile")).otherwise(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.col("tiles") - 1)))
    first = members.withColumn("group", F.explode(others)).select(F.xxhash64("group", "cluster").alias("tile"), "node", F.col("node").alias("comp"), F.lit(1).alias("side"), "size", "sig")
    near = written(_by_tile(first, _near, scheme, near_rows), "near")
    sets = _sets_of(documents, members, near)
    again = near.join(sets.hint("merge"), "node").select("tile", "node", "comp", "side", "own", "sig")
    out = written(_by_tile(again, _links, scheme, link_rows), "links")

    # in clusters of several tiles: the nodes outside the largest component with all nodes
    if members.where("tiles > 1").head(1):
        large = members.where("tiles > 1").select("node", "cluster", "tiles", "tile", "sig", "size")
        large = large.join(min_label_components(out), "node", "left").withColumn("comp", F.coalesce("component", "node"))
        per = large.groupBy("cluster", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
        top = per.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"))
        rest = per.join(top, "cluster").where("comp <> top").groupBy("cluster", "top").agg(F.greatest(F.ceil(F.sum("n") / TILE), F.ceil(F.sum("shingles") / TILE_SHINGLES)).cast("long").alias("rows"))
        large = written(large.join(rest, "cluster").withColumn("own_row", F.pmod(F.xxhash64("node"), "rows")), "large")
        left = large.where("comp <> top").withColumns({"r": F.col("own_row"), "c": F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)), "side": F.lit(1)})
        right = large.withColumns({"r": F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)), "c": F.col("tile"), "side": F.lit(0)})
        # a node that is on both sides of a group counts once, on side 1
        both = left.unionByName(right.where("comp = top or own_row <> r")).select(F.xxhash64(F.col("r") * 1_000_003 + F.col("c"), "cluster").alias("tile"), "node", "comp", "side", "size", "sig")
        near = written(_by_tile(both, _near, scheme, near_rows), "near")
        more = _sets_of(documents, members, near.join(sets.select("node"), "node", "left_anti"))
        again = near.join(sets.unionByName(more).hint("merge"), "node").select("tile", "node", "comp", "side", "own", "sig")
        out = out.unionByName(written(_by_tile(again, _links, scheme, link_rows), "links"))
    return out


def _per_node(nodes: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """(node, first, n, alone): the smallest (doc_id, h) of the component of each node."""
    comps = written(min_label_components(found).join(nodes.select("node", "first").hint("merge"), "node"), "components")
    smallest = written(comps.groupBy("component").agg(F.min("first").alias("first"), F.count("*").alias("n")), "components")
    linked = lookup(comps.select("node", "component"), smallest, ["component"], total).select("node", F.col("first").alias("linked"))
    own = nodes.join(linked.hint("merge"), "node", "left").select("node", F.coalesce("linked", "first").alias("first"), "n", F.col("linked").isNull().alias("alone"))
    return written(own, "ids")


def components(documents: DataFrame, scheme: Scheme = LINKS_85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): kept is true for the smallest doc_id of each component."""
    feats = features(documents)
    nodes, total = nodes_of(feats), feats.count()
    found = links(documents, feats, nodes, scheme)
    # rows that repeat a doc_id are one document, whatever their texts
    known = feats.where("doc_id is not null").select("doc_id", "node", "n_shingles")
    per = known.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"), F.count("node").alias("full"))
    several = written(per.where("low <> high or full between 1 and n - 1").select("doc_id", "low", "n"), "repeats")
    rows = feats.select("doc_id", "node", "n_shingles")
    if several.head(1):
        rows = lookup(rows, several, ["doc_id"], total, "left").select("doc_id", F.coalesce("node", "low").alias("node"), "n_shingles", "low")
        found = found.unionByName(rows.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())
        rows = rows.drop("low")
    ids = _per_node(nodes, found, total).select("node", F.col("first.doc_id").alias("node_id"), "n")
    out = lookup(rows.where("doc_id is not null"), ids, ["node"], total, "left").unionByName(rows.where("doc_id is null").withColumn("node_id", F.lit(None).cast("bigint")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("node_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, scheme: Scheme = LINKS_80) -> DataFrame:
    """The rows of ``documents``, with all their columns, one of each group of linked texts.

    Rows are told apart by doc_id and text here: the row with the smallest doc_id (then hash of the text)
    stays, once if it is repeated. Rows without a doc_id or without words all stay.
    """
    feats = features(documents)
    nodes, total = nodes_of(feats), feats.count()
    stays = written(_per_node(nodes, links(documents, feats, nodes, scheme), total).where("n > 1 or not alone").select("node", "first", "n"), "stays")
    real = feats.where("node is not null and doc_id is not null").select("doc_id", "h", "node")
    rows = lookup(real, stays, ["node"], total).groupBy("doc_id", "h", "first").agg(F.count("*").alias("times"))
    judged = written(rows.select("doc_id", "h", "times", ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))).alias("stays")).where("not stays or times > 1"), "gone")
    # the rows go along as one column, as theirs may have any name; only those the sieve can't clear are shuffled
    whole = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    sifted = sieve(whole, judged, ["doc_id", "h"])
    left = sifted.where("maybe").join(judged.where("not stays").select("doc_id", "h"), ["doc_id", "h"], "left_anti").drop("maybe")
    if judged.where("stays").head(1):
        again = judged.where("stays").select("doc_id", "h")
        left = left.join(again, ["doc_id", "h"], "left_anti").unionByName(left.join(again, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]))
    return sifted.where("not maybe").select("row.*").unionByName(left.select("row.*"))
