"""Lookup, semi, anti, OR and self joins.

Sides are broadcast only when a count proves them small (``small_side``);
otherwise Spark and its adaptive execution choose, and split skewed keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a looked-up side is broadcast.
SMALL = 50_000


def small_side(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; the count stops there."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys that occur once."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n = 1").select(key)


def lookup(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join whose missing values become defaults."""
    out = left.join(right, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def required(left: DataFrame, right: DataFrame, key: str, found: str) -> DataFrame:
    """Inner lookup that fails where a row is missing."""
    out = left.join(right, key, "left")
    return out.where(F.when(F.col(found).isNull(), F.raise_error(F.concat(F.lit("no stored row for "), F.col(key).cast("string"))).cast("boolean")).otherwise(True))


def by_any_column(keys: DataFrame, key: str, rows: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Rows of which any of the columns equals a key, once each: an equality join on the exploded columns, not an OR."""
    urls = rows.select(row_id, F.explode(F.array_distinct(F.array_compact(F.array(*columns)))).alias(key))
    return urls.join(keys.select(key).distinct(), key).select(row_id, key)


def first_match(truth: DataFrame, rows: DataFrame, truth_id: str, row_id: str, key: str, least: float = 0.5) -> DataFrame:
    """For each truth the row of equal ``key``, else the first row of an equal host with a token overlap of ``least`` or more."""
    direct = truth.join(rows.select(key, F.col(row_id).alias("direct")), key).groupBy(truth_id).agg(F.min("direct").alias("direct"))
    # rows of a host and token set count once, by their first; and so do truths of a host and token set, by what they find
    first = rows.where(F.size("tokens") > 0).groupBy("host", F.array_sort("tokens").alias("tokens")).agg(F.min(row_id).alias("loose"))
    hosts = truth.where(F.size("tokens") > 0).select(truth_id, F.explode("hosts").alias("host"), F.array_sort("tokens").alias("wanted"))
    shared = F.size(F.array_intersect("wanted", "tokens")) / F.least(F.size("wanted"), F.size("tokens"))
    found = hosts.select("host", "wanted").distinct().join(first, "host").where(shared >= least).groupBy("host", "wanted").agg(F.min("loose").alias("loose"))
    loose = hosts.join(found, ["host", "wanted"]).groupBy(truth_id).agg(F.min("loose").alias("loose"))
    out = truth.select(truth_id).join(direct, truth_id, "left").join(loose, truth_id, "left")
    return out.select(truth_id, F.coalesce("direct", "loose").alias("matched"), F.when(F.col("direct").isNotNull(), "key").when(F.col("loose").isNotNull(), "host").alias("how"))


def token_pairs(rows: DataFrame, row_id: str, tokens: str, block: str, least: float = 0.7, least_tokens: int = 2) -> DataFrame:
    """Pairs (a, b) of a block whose token sets overlap by ``least`` of the smaller.

    Only pairs that share their rarest tokens are made: with an overlap of
    ``least`` a set can miss ``floor((1 - least) * n)`` tokens of the smaller
    set, so it is enough to index that many tokens plus one, the rarest in the
    corpus first (prefix filtering); common tokens generate no pairs.
    """
    sets = rows.where(F.size(tokens) >= least_tokens).select(F.col(row_id).alias("id"), F.col(block).alias("block"), F.col(tokens).alias("t"))
    each = sets.select("id", "block", F.size("t").alias("n"), F.explode("t").alias("token"))
    rare = each.groupBy("token").agg(F.count("*").alias("df"))
    w = Window.partitionBy("id", "block").orderBy("df", "token")
    # the smaller set may be either side: a set of n tokens can meet one of n / least or fewer tokens
    prefix = each.join(rare, "token").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.col("n") - F.ceil(F.lit(least) * least_tokens) + 1)
    index = prefix.select("block", "token", "id")
    pairs = index.alias("x").join(index.alias("y"), ["block", "token"]).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "block").distinct()
    out = pairs.join(sets.select(F.col("id").alias("a"), "block", F.col("t").alias("ta")), ["a", "block"]).join(sets.select(F.col("id").alias("b"), "block", F.col("t").alias("tb")), ["b", "block"])
    shared = F.size(F.array_intersect("ta", "tb"))
    return out.withColumn("overlap", shared / F.least(F.size("ta"), F.size("tb"))).where(F.col("overlap") >= least).select("a", "b", "overlap")


def any_known(rows: DataFrame, row_id: str, hosts: str, key: str, known_hosts: DataFrame, known_keys: DataFrame) -> DataFrame:
    """Whether any host or the key of a row is known."""
    by_host = rows.select(row_id, F.explode_outer(hosts).alias("host")).join(known_hosts.select("host").distinct().withColumn("h", F.lit(True)), "host", "left").groupBy(row_id).agg(F.bool_or(F.coalesce("h", F.lit(False))).alias("by_host"))
    by_key = rows.select(row_id, key).join(known_keys.select(key).distinct().withColumn("k", F.lit(True)), key, "left").select(row_id, F.coalesce("k", F.lit(False)).alias("by_key"))
    return by_host.join(by_key, row_id).select(row_id, (F.col("by_host") | F.col("by_key")).alias("known"))


def latest_children(children: DataFrame, key: str, order: list[Column], keep: int, fields: list[str], name: str) -> DataFrame:
    """The ``keep`` first children of each key as a sorted array."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    top = children.withColumn("rn", rn).where(F.col("rn") <= keep)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def current_claim(claims: DataFrame, key: str, value: str) -> DataFrame:
    """As of now: the claim of the strongest (lowest) priority, the first of equal times, the latest of equal priorities."""
    best = F.min_by(F.struct(value, "priority", "observed_at", "seq"), F.struct("priority", -F.unix_micros(F.col("observed_at").cast("timestamp")), "seq"))
    return claims.groupBy(key).agg(best.alias("c")).select(key, "c.*")


def aggregators(records: DataFrame, directories: DataFrame, least: int = 3) -> DataFrame:
    """Sites of directories that hold calls of ``least`` or more organizers, or that are named like one."""
    named = F.col("name").rlike(r"(?i)directory|listings?|calls")
    per = records.groupBy("site").agg(F.count_distinct("organizer").alias("organizers"))
    return directories.join(per, "site", "left").select("site", F.coalesce("organizers", F.lit(0)).cast("bigint").alias("organizers"), (named | (F.coalesce("organizers", F.lit(0)) >= least)).alias("aggregator"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
