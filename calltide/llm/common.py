"""What the training-data operators share: tables, hold-outs, written tables, components.

Defined cases that hold for every operator here: a missing text counts as the
empty text, a missing ``doc_id`` is carried through as it is and is never
learned from, and columns beyond those an operator reads are ignored (or
passed through, where an operator says so) whatever their names are.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """True where crc32(doc_id as text) mod ``mod`` is ``rest``; a missing doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(mod) == F.lit(rest), F.lit(True))


#: Bytes of an Arrow batch that is sent to a Python worker, about. Spark's own 64 MB, times the copies
#: that a worker makes of texts, would be most of a small executor's memory.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the batches that the session sends to Python; called by applications (the queries, the pipeline), not by operators."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Only where the session names none and all runs in one process (as in
    tests) a temporary one is used; on a cluster that is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = context._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="calltide-")
        found = _OWN[context.applicationId]
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage.

    Lost executors cost at most the running tasks: what was written stays.
    """
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Removes the files of ``written`` tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_written_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


#: Edges that a task ties at once.
TIE = 1 << 17


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties the edges of a task, up to TIE at a time, into stars around the smallest connected nodes."""

    def tied(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        low, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
        while True:  # the smaller root of each edge's ends, and then of each node's root
            least = np.minimum(low[a], low[b])
            after = low.copy()
            np.minimum.at(after, low[a], least)
            np.minimum.at(after, low[b], least)
            after = after[after]
            if (after == low).all():
                break
            low = after
        leaf = low != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[low[leaf]])], names=["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n >= TIE:
            yield tied(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield tied(*map(np.concatenate, zip(*held, strict=True)))


#: A key that holds at least this share of the rows is hot; so there are at most 1 / HOT of them.
HOT = 0.001
#: Bits of a sieve, in rows of 64: at most half a million rows are broadcast, whatever the input.
SIEVE = 1 << 25


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``found``, which has a row for each of ``keys`` and in ``n`` the number of rows it stands for.

    The hot keys' rows of ``found``, at most 1 / HOT (times two for edges, which count at both
    ends), are broadcast, so that the rows of a hot key stay where they are; the others are shuffled,
    but for those with a missing key, at any size alike. ``found`` is read three times, so it is a written table.
    """
    least = max(1, int(total * HOT))
    hot, cold = F.broadcast(found.where(F.col("n") >= least).drop("n")), found.where(F.col("n") < least).drop("n")
    out = rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").dropna(subset=keys).join(cold.hint("merge"), keys, how))
    if how == "left":
        missing = F.lit(False)
        for k in keys:
            missing |= F.col(k).isNull()
        out = out.unionByName(rows.where(missing), allowMissingColumns=True)
    return out


def sieve(rows: DataFrame, wanted: DataFrame, keys: list[str], bits: int = SIEVE) -> DataFrame:
    """``rows`` with ``maybe``: true where ``keys`` (bigint) are in ``wanted``, and for some others; false only where they are not.

    A filter of a fixed number of bits, so what is broadcast doesn't grow; with more wanted keys than
    bits it lets more through. What it lets through is then joined, so that few of the rows are shuffled.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(bits))
    words = wanted.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("sieve_word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("sieve_bits"))
    marked = rows.join(F.broadcast(words), F.shiftright(at, 6) == F.col("sieve_word"), "left")
    hit = F.coalesce(F.getbit("sieve_bits", (at % 64).cast("int")) == 1, F.lit(False))
    return marked.withColumn("maybe", hit).drop("sieve_word", "sieve_bits")


def min_label_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60, tied: bool = False) -> DataFrame:
    """Connected components of an undirected graph as rows (node, component), component the smallest node (nodes are bigint).

    Edges are tied into stars task by task, up to TIE at a time; when all fit one task that is the end. Edges from
    a Python worker come ``tied`` by it: a second one in the same task would stay in the executor's memory.
    Else alternating large-star and small-star steps each replace the edges by
    stars of the smallest neighbour and keep the components; rounds grow with
    the logarithm of the component size. A step is a minimum per node and a
    lookup of it, for which the edges of a node with a great many of them are not shuffled, so no
    task holds a group. Isolated nodes do not occur in the result.
    """
    own = edges.select(F.greatest(src, dst).cast("bigint").alias("u"), F.least(src, dst).cast("bigint").alias("v")).where("u <> v")
    now = written((own if tied else own.mapInArrow(stars, "u bigint, v bigint")).distinct(), "edges")
    for _ in range(max_rounds):
        total = now.count()
        parts = -(-total // TIE)
        tied = written(now.coalesce(max(1, parts)).mapInArrow(stars, "u bigint, v bigint"), "edges")
        drop_written(now)
        now = tied
        if parts <= 1:
            break
        # stars only: every node is a leaf of one star, or a centre
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
        ends = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
        if not ends.where("leaf + centre > 1 and leaf > 0").head(1):
            break
        # large star: every neighbour larger than u goes to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "edges")
        large = written(lookup(both.where("v > u"), low, ["u"], total).select(F.col("v").alias("u"), F.col("m").alias("v")), "edges")
        # small star: every neighbour smaller than u, and u itself, goes to the smallest of them
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "edges")
        small = lookup(large, least, ["u"], total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = written(small.distinct(), "edges")
        drop_written(now, low, large, least)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
