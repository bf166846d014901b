"""Incremental state: URL cache, sightings, claims, budget ledger, checkpoints and merges.

Where a state has a closed form (conflicts, too) it is an aggregation or a window; where each
event changes what the next may do (the budget ledger) it is an ordered fold over
streamed batches that carries a few numbers for a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed_keys(old: Column, new: Column) -> Column:
    """Keys of either map whose values are distinct (null counts as a value), sorted."""
    keys = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    return F.filter(keys, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k)))


def is_empty(c: Column, kind: str) -> Column:
    """Null, empty text and empty arrays are empty; false and 0 are not."""
    if kind == "string":
        return c.isNull() | (c == "")
    if kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def merge_rows(existing: DataFrame, incoming: DataFrame, key: str, sticky: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Upsert that keeps fields: incoming values win unless empty; ``sticky`` gives other rules by column.

    One full outer join on the key; ``action`` is inserted, updated or kept.
    """
    kinds = dict(existing.dtypes)
    old, new = existing.alias("o"), incoming.alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    columns = []
    for c in existing.columns:
        if c == key:
            continue
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        value = F.when(F.col(f"n.{key}").isNull() | is_empty(n, kinds[c]), o).otherwise(n)
        if sticky and c in sticky:
            value = F.when(F.col(f"o.{key}").isNull(), n).when(F.col(f"n.{key}").isNull(), o).otherwise(sticky[c](o, n))
        columns.append(value.alias(c))
    action = F.when(F.col(f"o.{key}").isNull(), "inserted").when(F.col(f"n.{key}").isNull(), "kept").otherwise("updated")
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *columns, action.alias("action"))


def replace_rows(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Upsert in which incoming rows replace whole rows."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def insert_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming rows whose key is not there yet, the first of each key (by seq)."""
    fresh = incoming.join(existing.select(key), key, "left_anti")
    rest = [c for c in fresh.columns if c != key]
    return fresh.groupBy(key).agg(F.min_by(F.struct(*rest), "seq").alias("v")).select(key, "v.*")


def collapse(rows: DataFrame, key: str, best: Column, seq: str) -> DataFrame:
    """One row per key: the best, the first on ties."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(best, -F.col(seq))).alias("v")).select(key, "v.*")


def hash_changes(observations: DataFrame, key: str, value: str, at: str, tie: str) -> DataFrame:
    """Observations whose content differs from the one before, with a running number of changes."""
    w = Window.partitionBy(key).orderBy(at, tie)
    out = observations.withColumn("before", F.lag(value).over(w))
    return out.withColumn("changed", F.col("before").isNull() | (F.col("before") != F.col(value)))


def failure_backoff(failures: Column) -> Column:
    """Minutes to the next try: 15, doubled for each failure up to seven times, a day at most."""
    return F.least(F.lit(1440), F.lit(15) * F.pow(F.lit(2), F.least(failures - 1, F.lit(7))).cast("int"))


def defer_hours(hours: Column) -> Column:
    return F.least(F.greatest(hours, F.lit(1)), F.lit(168))


def budget_ledger(requests: DataFrame, hard: float, soft: float, daily: int) -> DataFrame:
    """Decides requests (key, at, seq, cost, units, optional, idem) one after the other.

    A blocked request costs nothing and so changes what the next may do: a true
    fold, per pool and month (``key``), ordered by time. It streams over sorted batches and
    carries three numbers; a repeated idempotency key, which is a replay, is found before by a window.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, today, spent, used = None, None, 0.0, 0
        for b in batches:
            codes, sums = [], []
            for key, day, cost, units, optional, replay in zip(*(b.column(c).to_pylist() for c in ("key", "day", "cost", "units", "optional", "replay")), strict=True):
                if key != last:
                    last, today, spent, used = key, None, 0.0, 0
                if day != today:
                    today, used = day, 0
                if replay:
                    code = "idempotent-replay"
                elif cost > 0 and spent + cost > hard:
                    code = "monthly-hard-cap"
                elif cost > 0 and optional and spent + cost >= soft:
                    code = "optional-disabled"
                elif used + units > daily:
                    code = "daily-provider-limit"
                else:
                    code, spent, used = "reserved", spent + cost, used + units
                codes.append(code)
                sums.append(round(spent, 6))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("seq"), pa.array(codes, pa.string()), pa.array(sums, pa.float64())], names=["key", "seq", "decision", "spent"])

    again = F.row_number().over(Window.partitionBy("key", "idem").orderBy("at", "seq")) > 1
    rows = requests.select(
        F.col("key").cast("string").alias("key"), F.col("seq").cast("bigint").alias("seq"), "at", F.date_format("at", "yyyy-MM-dd").alias("day"), F.col("cost").cast("double").alias("cost"), F.col("units").cast("bigint").alias("units"), "optional",
        again.alias("replay"))
    dealt = rows.repartition("key").sortWithinPartitions("key", "at", "seq").drop("at")
    return dealt.mapInArrow(fold, "key string, seq bigint, decision string, spent double")


def running_spend(requests: DataFrame) -> DataFrame:
    """The closed form when nothing is blocked: a running sum per key."""
    w = Window.partitionBy("key").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return requests.withColumn("spent", F.sum("cost").over(w))


def observe(claims: DataFrame) -> DataFrame:
    """Says of each of the claims (key, at, seq, priority, value, source), taken in order, whether it applied and conflicted, and what holds after it.

    A claim applies if it is the first, stronger (a lower number), or as strong and strictly newer. So the one that holds
    is, of all before, the strongest, then the newest, then the first: a running minimum. A claim
    conflicts if the value that holds when it comes is from another source and distinct.
    """
    c = F.col
    rank = F.struct(c("priority"), (-F.unix_micros(c("at").cast("timestamp"))).alias("down"), c("seq"), c("at"), c("value"), c("source"))
    before = F.min(rank).over(Window.partitionBy("key").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = claims.withColumn("now", before)
    applied = c("now").isNull() | (c("priority") < c("now.priority")) | ((c("priority") == c("now.priority")) & (c("at") > c("now.at")))
    conflict = c("now").isNotNull() & ~c("now.source").eqNullSafe(c("source")) & ~c("now.value").eqNullSafe(c("value"))
    return rows.select("key", "seq", applied.alias("applied"), conflict.alias("conflict"), F.when(applied, c("value")).otherwise(c("now.value")).alias("holds"))


def health_after(outcome: Column, failures: Column) -> Column:
    return F.when(outcome == "blocked", "blocked").when(failures >= 3, "failing").when(failures > 0, "degraded").otherwise("healthy")


def advance_page(page: Column, explicit: Column, most: Column, exhausted: Column) -> Column:
    """The next page and whether the cycle ended: an explicit page wins, the end goes back to page 1."""
    done = exhausted | (page >= most)
    next_page = F.when(explicit.isNotNull(), F.least(F.greatest(explicit, F.lit(1)), most)).when(done, 1).otherwise(page + 1)
    return F.struct(next_page.alias("page"), F.when(explicit.isNull() & done, 1).otherwise(0).alias("cycles"))


def advance_window(offset: Column, window: Column, most: Column, total: Column, exhausted: Column) -> Column:
    """The next offset of a link window; it wraps at the end, at the limit and when exhausted."""
    proposed = F.least(most, offset + window)
    wrap = exhausted | (proposed >= most) | (proposed >= total)
    return F.struct(F.when(wrap, 0).otherwise(proposed).alias("offset"), F.when(wrap, 1).otherwise(0).alias("cycles"))


def apply_reviews(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Optimistic locking: a review applies only to the version it was written for; the rest come back as stale."""
    both = rows.alias("o").join(reviews.alias("r"), "id", "left")
    hit = F.col("r.version").isNotNull() & (F.col("r.version") == F.col("o.version"))
    outcome = F.when(F.col("r.version").isNull(), "none").when(hit, "applied").otherwise("stale")
    return both.select("id", F.when(hit, F.col("r.decision")).otherwise(F.col("o.decision")).alias("decision"), (F.col("o.version") + F.when(hit, 1).otherwise(0)).alias("version"), outcome.alias("outcome"))


def protect_approved(old: DataFrame, update: DataFrame, facts: list[str], risky: str) -> DataFrame:
    """Automated updates keep the facts of approved rows; a risky change sends the row back to pending."""
    both = old.alias("o").join(update.alias("n"), "id")
    approved = F.col("o.review_decision") == "approved"
    changed = ~F.col(f"o.{risky}").eqNullSafe(F.col(f"n.{risky}"))
    values = [F.when(approved, F.col(f"o.{f}")).otherwise(F.col(f"n.{f}")).alias(f) for f in facts]
    return both.select("id", *values, F.when(approved & changed, "pending").otherwise(F.col("o.review_decision")).alias("review_decision"))
