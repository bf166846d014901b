"""What surrounds the pipeline, as tables: retries, search results, model rotation, schedules, budgets of time, bounded ingest, logs that only grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U

#: Times of day (UTC) at which jobs start, by name (fixed values).
SCHEDULE = {"monitor": [(4, 43), (16, 43)], "discovery": [(6, 17), (18, 17)]}
#: Most records of one ingest.
MOST_RECORDS = 250


def settle_attempts(attempts: DataFrame, key: str, most: int = 2) -> DataFrame:
    """The outcome per key of attempts (key, attempt, url, ok, http_status, reason, error): the first that is not retried.

    Server errors, failed fetches and timeouts are retried up to ``most`` attempts (three at most); a broken certificate is retried once over http, and
    counts if that works (``tls_fallback``).
    """
    most = max(1, min(3, most))
    tls = (F.col("reason") == "FETCH_FAILED") & F.col("error").rlike("(?i)CERT|TLS|SSL|UNABLE_TO_VERIFY|SELF_SIGNED|DEPTH_ZERO") & F.col("url").rlike("(?i)^https:")
    transient = F.coalesce(F.col("http_status") >= 500, F.lit(False)) | F.coalesce(F.col("reason").isin("FETCH_FAILED", "FETCH_TIMEOUT"), F.lit(False))
    tls = F.coalesce(tls, F.lit(False))
    plain = attempts.where(F.col("url").rlike("(?i)^http:") & F.col("ok")).select(key, F.lit(True).alias("plain_ok")).distinct()
    rows = attempts.where(~F.col("url").rlike("(?i)^http:") | (F.col("attempt") == 1))
    last = rows.withColumns({"tls": tls, "ends": F.col("ok") | tls | (F.col("attempt") >= most) | ~transient})
    first = last.where("ends").groupBy(key).agg(F.min_by(F.struct("attempt", "ok", "http_status", "reason", "tls"), "attempt").alias("r"))
    out = first.join(plain, key, "left")
    fallback = F.col("r.tls") & F.coalesce("plain_ok", F.lit(False))
    return out.select(key, F.col("r.attempt").alias("attempts"), (F.col("r.ok") | fallback).alias("ok"), fallback.alias("tls_fallback"), F.when(~fallback, F.col("r.reason")).alias("reason"))


def search_results(hits: DataFrame, credits: int, cap: int, per_search: int = 1) -> DataFrame:
    """Ranked hits (query_id, seq, rank, url, title, score) of the searches that the month's credits still pay, in their order, with canonical URLs, each once per query."""
    searches = hits.select("query_id", "seq").distinct()
    # a search that comes when the cap is reached is not made, nor is any after it
    most = max(0, (cap - credits) // per_search)
    paid = searches.orderBy("seq", "query_id").limit(most)
    rows = hits.join(paid.select("query_id"), "query_id").withColumn("url", U.canonical(F.col("url"))).where("url is not null")
    return rows.groupBy("query_id", "url").agg(F.min(F.struct("rank", "title", "score")).alias("m")).select("query_id", "url", "m.rank", "m.title", "m.score")


def next_model(models: DataFrame, now: Column) -> DataFrame:
    """The model to ask next (one row, or none if all are used up): the first that is ready, else the one that is ready soonest, and the wait in milliseconds.

    ``models``: place, model, cooldown_until (or null), exhausted.
    """
    wait = F.greatest(F.lit(0), F.coalesce(F.unix_millis(F.col("cooldown_until").cast("timestamp")) - F.unix_millis(now.cast("timestamp")), F.lit(0)))
    usable = models.where(~F.coalesce("exhausted", F.lit(False))).withColumn("wait_ms", wait)
    return usable.orderBy("wait_ms", "place").limit(1).select("model", "wait_ms")


def text_budget(token_limit: Column, fixed_tokens: Column, output_tokens: int, most: int) -> Column:
    """Characters of a page that fit a prompt: four a token, with a tenth of the limit as margin."""
    room = (F.floor(token_limit * 0.9) - output_tokens - fixed_tokens) * 4
    return F.when(token_limit > 0, F.least(F.lit(most), F.greatest(F.lit(0), room))).otherwise(F.lit(most))


def clean_secret(value: Column) -> Column:
    """A secret as it was pasted, without its name, `Bearer` and quotes; null if nothing is left."""
    t = F.regexp_replace(F.trim(value), r"^[A-Z][A-Z0-9_]*\s*=\s*", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i)^bearer\s+", ""), "^[\"'`]+|[\"'`]+$", ""))
    return F.when(t != "", t)


def next_start(job: str, now: Column) -> Column:
    """When a job of the schedule starts next, after ``now``."""
    day = F.date_trunc("day", now)
    times = [day + F.make_dt_interval(F.lit(d), F.lit(h), F.lit(m)) for d in (0, 1) for h, m in SCHEDULE[job]]
    return F.array_min(F.filter(F.array(*times), lambda t: t > now))


def within_time(work: DataFrame, order: list[str], seconds: str, budget: float) -> DataFrame:
    """The pieces of work that are started before the time is used up, one after the other: those before which less than ``budget`` was spent.

    The spent time is summed in two steps, so that no task sorts all work.
    """
    w = work.withColumn("slice", F.floor(F.col(order[0]) / 1000))
    per = w.groupBy("slice").agg(F.sum(seconds).alias("s"))
    per = per.withColumn("before", F.sum("s").over(Window.orderBy("slice")) - F.col("s")).select("slice", "before")  # a row per thousand
    inside = F.sum(seconds).over(Window.partitionBy("slice").orderBy(*order)) - F.col(seconds)
    return w.withColumn("own", inside).join(per, "slice").withColumn("spent", F.col("before") + F.col("own")).where(F.col("spent") < budget).drop("slice", "own", "before")


def ingest_answer(authorized: Column, body: Column) -> Column:
    """(status, accepted) of an ingest request: 401, 400 for what is no array of 1 to MOST_RECORDS records, else 200."""
    v = F.try_parse_json(body)
    records = F.size(F.try_variant_get(v, "$", "array<variant>"))
    status = F.when(~F.coalesce(authorized, F.lit(False)), 401).when(F.coalesce(records, F.lit(-1)).between(1, MOST_RECORDS), 200).otherwise(400)
    return F.struct(status.alias("status"), F.when(status == 200, records).otherwise(0).alias("accepted"))


def append_only(log: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(log, refused): inserts of new keys are added; updates, deletes and keys that are there already are refused. ``changes`` has an ``action`` beside the log's columns."""
    inserts = changes.where("action = 'insert'").drop("action").dropDuplicates([key]).join(log.select(key), key, "left_anti").select(*log.columns)
    refused = changes.where("action <> 'insert'").unionByName(changes.where("action = 'insert'").join(log.select(key), key, "left_semi").select(*changes.columns))
    return log.unionByName(inserts), refused


def touched(before: DataFrame, after: DataFrame, key: str, now: Column) -> DataFrame:
    """``after`` with ``updated_at``: now where a row is new or differs from ``before`` in any other column, else as it was."""
    columns = [c for c in after.columns if c not in (key, "updated_at")]
    old = before.select(key, F.struct(*columns).alias("old"), F.col("updated_at").alias("was"))
    same = F.col("old").isNotNull() & F.struct(*columns).eqNullSafe(F.col("old"))
    return after.drop("updated_at").join(old, key, "left").withColumn("updated_at", F.when(same, F.col("was")).otherwise(now)).drop("old", "was")


def audit_report(rows: DataFrame, public_count: int | None) -> DataFrame:
    """(section, label, n): the report of an audit in one pass: rows, public rows as counted elsewhere, counts by category, status and kind of gap, duplicate keys."""
    gap = lambda name, missing: F.count_if(missing).alias(name)
    one = rows.agg(F.count("*").alias("rows"), gap("no deadline", F.col("deadline").isNull()), gap("no official page", F.col("official_url").isNull()), gap("no application page", F.col("application_url").isNull()), gap("conflict", F.col("has_conflict")))
    wide = one.select(F.inline(F.array(*[F.struct(F.lit("total" if c == "rows" else "gap").alias("section"), F.lit(c).alias("label"), F.col(f"`{c}`").alias("n")) for c in one.columns])))
    by = rows.groupingSets([["category"], ["status"]], "category", "status").agg(F.count("*").alias("n"), F.grouping("category").alias("g"))
    by = by.select(F.when(F.col("g") == 0, "category").otherwise("status").alias("section"), F.coalesce("category", "status").alias("label"), "n")
    twice = rows.groupBy("canonical_key").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n")).select(F.lit("duplicates").alias("section"), F.lit("canonical_key").alias("label"), "n")
    out = wide.unionByName(by).unionByName(twice)
    if public_count is None:
        return out
    return out.unionByName(rows.sparkSession.createDataFrame([("total", "public", public_count)], "section string, label string, n bigint"))


def cost_report(ledger: DataFrame, attempts: DataFrame, start: Column, now: Column, budget: float) -> DataFrame:
    """One row: the month's counted cost, its utilization and run rate, and what a gap search yields.

    ``ledger``: provider, operation, status, at, reserved, estimated; ``attempts``: kind, queries, candidates, validated, opportunities, sources, cost. Reserved costs count until they are settled.
    """
    cost = F.when(F.col("status") == "reserved", F.col("reserved")).when(F.col("status").isin("succeeded", "uncertain"), F.coalesce("estimated", "reserved")).otherwise(0.0)
    spent = ledger.where((F.col("at") >= start) & (F.col("at") <= now)).agg(F.count("*").alias("events"), F.coalesce(F.sum(F.greatest(cost, F.lit(0.0))), F.lit(0.0)).alias("spent"))
    names = ["queries", "candidates", "validated", "opportunities", "sources", "cost"]
    gaps = attempts.where("kind = 'gap-search'").agg(*[F.coalesce(F.sum(F.greatest(F.col(c), F.lit(0))), F.lit(0)).alias(c) for c in names])
    days = F.greatest(F.lit(1.0), (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))) / F.lit(86_400.0))
    rate = F.col("spent") / days * F.dayofmonth(F.last_day(now))
    per = lambda a, b, places, times=1: F.when(F.col(b) > 0, F.round(times * F.col(a) / F.col(b), places))
    return spent.crossJoin(gaps).select(  # one row each
        "events", F.round("spent", 8).alias("spent"), F.round(F.col("spent") / budget, 4).alias("utilization"), F.round(rate, 2).alias("run_rate"), F.round(F.least(rate, F.lit(budget)), 2).alias("enforced"), "queries",
        per("opportunities", "queries", 2, 100).alias("opportunities_per_100"), per("sources", "queries", 2, 100).alias("sources_per_100"), per("cost", "validated", 6).alias("cost_per_validated"), per("cost", "sources", 6).alias("cost_per_source"))
