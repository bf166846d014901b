"""Grouped metrics: one pass each where the figures share their rows.

Aggregations combine on the map side; group keys that expected reports miss
are filled in from a key list rather than with a scan of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pct(part: Column, whole: Column, places: int = 1) -> Column:
    """A percentage, null without anything to divide by."""
    return F.round(F.try_divide(part * F.lit(100.0), whole.cast("double")), places)


def count_by(rows: DataFrame, selector: Column, expected: list[str]) -> DataFrame:
    """Counts by a label (null is `unknown`) with zeros for expected labels that do not occur."""
    found = rows.select(F.coalesce(selector, F.lit("unknown")).alias("label"))
    zeros = found.sparkSession.createDataFrame([(x,) for x in expected], "label string").select("label", F.lit(0).alias("one"))
    return found.select("label", F.lit(1).alias("one")).unionByName(zeros).groupBy("label").agg(F.sum("one").cast("bigint").alias("n"))


def audit_buckets(rows: DataFrame, now: Column) -> DataFrame:
    """Total, the three exclusive states and the overlapping unknown, in one pass."""
    expired = (F.col("status") == "closed") | F.coalesce(F.col("deadline") < now, F.lit(False))
    upcoming = ~expired & F.coalesce(F.col("opens_at") > now, F.lit(False))
    return rows.agg(
        F.count("*").alias("total"), F.count_if(expired).alias("expired"), F.count_if(upcoming).alias("upcoming"), F.count_if(~expired & ~upcoming).alias("active"),
        F.count_if(F.col("deadline").isNull() | (F.col("deadline_status") == "unknown")).alias("unknown"),
        F.count_if(F.col("status").isin("verified", "open", "closing-soon")).alias("published"))


def known(c: Column) -> Column:
    """Neither null nor empty text."""
    return c.isNotNull() & (c.cast("string") != "")


def completeness(rows: DataFrame, fields: list[str], groups: dict[str, Column]) -> DataFrame:
    """For each group of rows and field how many values are known, and the percentage; all from one aggregation."""
    figures = [F.count_if(g & known(F.col(f))).alias(f"{n}|{f}") for n, g in groups.items() for f in fields]
    totals = [F.count_if(g).alias(f"{n}|") for n, g in groups.items()]
    one = rows.agg(*figures, *totals)
    flat = F.array(*[F.struct(F.lit(n).alias("grp"), F.lit(f).alias("field"), F.col(f"`{n}|{f}`").alias("n"), F.col(f"`{n}|`").alias("total")) for n in groups for f in fields])
    return one.select(F.inline(flat)).withColumn("pct", pct(F.col("n"), F.col("total")))


def duplicate_groups(rows: DataFrame, key: Column, row_id: str, limit: int = 100) -> DataFrame:
    """The largest groups of equal keys, by a hash of the key, with the totals over all groups."""
    groups = rows.groupBy(key.alias("k")).agg(F.count("*").alias("size"), F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id")).where("size > 1")
    totals = groups.agg(F.count("*").alias("all_groups"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("all_rows"))
    top = groups.orderBy(F.desc("size"), "first_id").limit(limit)
    return top.crossJoin(F.broadcast(totals)).select(F.substring(F.sha2(F.col("k").cast("string"), 256), 1, 16).alias("digest"), "size", "first_id", "last_id", "all_groups", "all_rows")


def usage_ledger(events: DataFrame) -> DataFrame:
    """Per provider and operation: events by outcome, summed JSON units and counted cost."""
    return events.groupBy("provider", "operation").agg(
        F.count("*").alias("events"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "uncertain").alias("uncertain"),
        F.count_if(F.col("status") == "blocked").alias("blocked"), F.sum(F.coalesce(F.get_json_object("units", "$.k").cast("bigint"), F.get_json_object("units", "$.reserved").cast("bigint"), F.lit(0))).alias("units"),
        F.round(F.sum(F.when(F.col("status") != "blocked", F.col("cost")).otherwise(0)), 2).alias("cost"))


def spend_by_pool(events: DataFrame, month_start: Column) -> DataFrame:
    """Cost of counted events since the start of the month, for the search pool and the core pool."""
    pool = F.when(F.col("provider") == "exa", "exa").otherwise("core")
    counted = events.where(F.col("status").isin("reserved", "succeeded", "uncertain") & (F.col("occurred_at") >= month_start))
    cost = F.when(F.col("status") == "reserved", F.col("reserved_cost")).otherwise(F.coalesce("cost", F.lit(0.0)))
    return counted.groupBy(pool.alias("pool")).agg(F.round(F.sum(cost), 2).alias("spend"))


def economics(rows: DataFrame, keys: list[str], checks: str, finds: str, wrong: str, cost: str) -> DataFrame:
    """Rates per hundred checks, cost per find and share of false positives; null where nothing was counted."""
    out = rows.groupBy(*keys).agg(*[F.sum(c).alias(n) for c, n in ((checks, "checks"), (finds, "finds"), (wrong, "wrong"), (cost, "cost"))])
    ratio = lambda a, b, k=1.0: F.round(F.try_divide(F.col(a) * F.lit(k), F.col(b).cast("double")), 4)
    return out.select(*keys, "checks", "finds", ratio("finds", "checks", 100.0).alias("finds_per_100"), ratio("cost", "finds").alias("cost_per_find"), ratio("wrong", "finds").alias("false_rate"))


def query_yield(hits: DataFrame) -> DataFrame:
    """Per query: URLs admitted, keys validated (credited to a key's first hit only), and hosts new with it."""
    from ..functions.url import host

    first = hits.groupBy("item").agg(F.min_by("query_id", F.struct("rank", "query_id")).alias("query_id"))
    credit = first.groupBy("query_id").agg(F.count("*").alias("validated"))
    seen = hits.select("query_id", "url", host(F.col("url")).alias("host"))
    per = seen.groupBy("query_id").agg(F.count_distinct("url").alias("admitted"), F.count_distinct("host").alias("hosts"))
    return per.join(credit, "query_id", "left").select("query_id", "admitted", "hosts", F.coalesce("validated", F.lit(0)).cast("bigint").alias("validated"))


def recall(rows: DataFrame, matched: Column) -> list[Column]:
    """Totals, matches, and recall with four and percent with two places."""
    total, hit = F.count("*"), F.count_if(matched)
    return [total.alias("total"), hit.alias("matched"), F.round(F.try_divide(hit.cast("double"), total), 4).alias("recall"), F.round(F.try_divide(hit * F.lit(100.0), total), 2).alias("percent")]


def grouped_recall(rows: DataFrame, dims: list[str], matched: str) -> DataFrame:
    """Recall overall and by each dimension alone, from one pass over GROUPING SETS."""
    labelled = rows.select(F.col(matched).alias("hit"), *[F.when(F.col(d).isNull() | (F.col(d) == ""), "Unknown").otherwise(F.col(d)).alias(d) for d in dims])
    sets = labelled.groupingSets([[], *[[F.col(d)] for d in dims]], *[F.col(d) for d in dims]).agg(*recall(labelled, F.col("hit")), F.grouping_id().alias("g"))
    name, label = F.lit("overall"), F.lit("all")
    for i, d in enumerate(dims):
        bit = (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - i))
        name, label = F.when(F.col("g") == bit, d).otherwise(name), F.when(F.col("g") == bit, F.col(d)).otherwise(label)
    return sets.select(name.alias("dimension"), label.alias("label"), "total", "matched", "recall", "percent")


def chapman(n1: Column, n2: Column, both: Column) -> Column:
    """The Chapman estimate of a population from two captures."""
    return F.floor((n1 + 1) * (n2 + 1) / (both + 1) - 1 + 0.5).cast("bigint")


def channel_hosts(rows: DataFrame, series: str, least: int = 3) -> DataFrame:
    """Hosts that carry ``least`` or more distinct series."""
    return rows.groupBy("host").agg(F.count_distinct(series).alias("series")).where(F.col("series") >= least)


def merge_seeds(rows: DataFrame, key: str) -> DataFrame:
    """One row per URL: the strongest policy of its rows, united categories, and the first known country by order."""
    first_known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    family = F.min_by("source_family", F.when(F.col("source_family") != "official-site", F.col("seq")))
    out = rows.groupBy(key).agg(
        F.min("priority").alias("priority"), F.min("tier").alias("tier"), F.min("poll").alias("poll"), F.min("min_poll").alias("min_poll"), F.max("max_poll").alias("max_poll"),
        F.min("next_check_at").alias("next_check_at"), first_known("country").alias("country"), F.coalesce(family, F.lit("official-site")).alias("source_family"),
        F.slice(F.array_sort(F.collect_set("category")), 1, 32).alias("categories"))
    return out.withColumn("max_poll", F.greatest("max_poll", "poll"))


def reason_map(rejects: DataFrame, keys: list[str]) -> DataFrame:
    """Rejection reasons in upper case with their counts, as a sorted text map."""
    n = rejects.groupBy(*keys, F.upper("reason").alias("reason")).agg(F.sum("n").alias("n"))
    entry = F.concat("reason", F.lit("="), F.col("n").cast("string"))
    return n.groupBy(*keys).agg(F.sum("n").alias("rejected"), F.array_join(F.array_sort(F.collect_list(entry)), ";").alias("reasons"))


def health(runs: DataFrame, kinds: list[str]) -> DataFrame:
    """The last run of each kind, in one pass."""
    return runs.agg(F.count("*").alias("runs"), *[F.max(F.when(F.col("kind") == k, F.col("finished_at"))).alias(f"last_{k}") for k in kinds])


def shared_pages(rows: DataFrame, url: Column, row_id: str) -> DataFrame:
    """Rows whose page is theirs alone."""
    counts = rows.withColumn("page", url)
    return counts.withColumn("n", F.count("*").over(Window.partitionBy("page"))).where("n = 1").select(row_id, "page")


def cost_projection(days: int, limit: int, unit: float, budget: float, multipliers: tuple[int, ...], frame: DataFrame) -> DataFrame:
    """Configured cost for each multiplier, never above the budget. ``frame`` has one row."""
    return frame.select(F.explode(F.array(*map(F.lit, multipliers))).alias("multiplier")).select("multiplier", F.round(F.least(F.lit(float(budget)), F.col("multiplier") * F.lit(days * limit * unit)), 4).alias("cost"))
