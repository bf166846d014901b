"""Lineage cuts, connected components and one-to-one assignment by rounds of joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a temporary one where it names none and all runs in one process, else an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and context._jsc.sc().getCheckpointDir().isDefined():
        found = context._jsc.sc().getCheckpointDir().get()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = _OWN.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="calltide-")
        _OWN[context.applicationId] = found
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, which cuts its lineage and survives lost executors."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as compressed columns and read again: cuts lineage like ``settled``, for tables that grow with the input."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the connected nodes of edges (a, b), component the smallest node; nodes without an edge do not occur.

    Large-star and small-star steps in turn: each ties the neighbours of a node to the smallest of them, and
    keeps the components. The number of rounds grows with the logarithm of the size of the largest component.
    """
    now = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settled(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        if not after.exceptAll(now).head(1) and not now.exceptAll(after).head(1):
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        now = after


def assign(pairs: DataFrame, left: list[str], right: list[str], order: list[str]) -> DataFrame:
    """The pairs that a greedy pass in ``order`` (ascending, ties by left and right) takes, each left and each right once.

    A pair that is the first of its left and of its right is taken whatever the others do; so each round takes
    all such pairs and drops those that have lost a side, until none is left.
    """
    now, taken = settled(pairs.withColumn("place", F.struct(*order, *left, *right)).distinct()), None
    while now.head(1):
        firsts = [now.groupBy(*side).agg(F.min("place").alias(f"first_{i}")) for i, side in enumerate((left, right))]
        best = settled(now.join(firsts[0], left).where("place = first_0").join(firsts[1], right).where("place = first_1").drop("first_0", "first_1"))
        taken = best if taken is None else taken.unionByName(best)
        now = settled(now.join(best.select(*left), left, "left_anti").join(best.select(*right), right, "left_anti"))
    return (now if taken is None else taken).select(*pairs.columns)
