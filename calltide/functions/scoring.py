"""Scores and decision tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import host


def hash_fraction(key: Column, salt: str) -> Column:
    """A number from 0 to 1 out of the first 32 bits of a salted SHA-256."""
    digest = F.sha2(F.concat(F.lit(salt + "\u001f"), key), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def held_out_by_hash(key: Column, salt: str, fraction: float = 0.2) -> Column:
    """Membership of a hold-out, the same for a key wherever it occurs; empty keys are never held out."""
    return F.coalesce((key != "") & (hash_fraction(key, salt) < fraction), F.lit(False))


def hash_parts(*parts: Column) -> Column:
    """SHA-256 of parts joined by the unit separator; missing parts are empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def when(condition: Column, value: float) -> Column:
    """``value`` where the condition holds, else 0."""
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0 if isinstance(value, float) else 0))


def confidence_score() -> Column:
    """How sure a record is: a base of 0.18 and a weight for each piece of evidence (fixed values), from 0 to 1."""
    ok = lambda c: F.col(f"{c}_status").isin("verified", "redirected")
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    score = (
        F.lit(0.18) + when(ok("source_url"), 0.18) + when(F.col("source_type") == "official", 0.12) + when(has("official_url") & (F.col("official_url_status") != "invalid"), 0.17)
        + when(has("application_url"), 0.08) + when(F.col("deadline").isNotNull() & (F.col("deadline_status") == "confirmed"), 0.12) + when(has("summary"), 0.04)
        + when(has("eligibility"), 0.03) + when(has("tags"), 0.03) + when(has("location") & (F.col("location") != "Unspecified"), 0.03)
        + F.least(F.greatest(F.col("confidence") * 0.02, F.lit(0.0)), F.lit(0.02))
    )
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3)


def team_only(*urls: Column) -> Column:
    """A tag of the platform whose data are for the team only, or one of ``urls`` there."""
    own = F.exists(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: (t == "platform:festhome") | t.startswith("festhome:"))
    for url in urls:
        own |= F.coalesce(host(url).rlike(r"(?:^|\.)festhome\.com$"), F.lit(False))
    return own


def missing_organizer() -> Column:
    return F.lower(F.trim(F.coalesce("organizer", F.lit("")))).isin("", "unknown", "unknown organizer")


def official_page(url: Column | None = None, url_status: Column | None = None) -> Column:
    """The record has a verified page of its own; ``url`` and ``url_status`` stand for its official ones if given."""
    url, url_status = F.col("official_url") if url is None else url, F.col("official_url_status") if url_status is None else url_status
    by_own = url.isNotNull() & url_status.isin("verified", "redirected")
    by_source = (F.col("source_type") == "official") & F.col("source_url_status").isin("verified", "redirected")
    return F.coalesce(by_own, F.lit(False)) | F.coalesce(by_source, F.lit(False))


def blockers(status: Column, now: Column, url: Column | None = None, url_status: Column | None = None) -> Column:
    """The codes, in order, of what keeps a record from being published with a status (and official page, if given)."""
    rolling = F.col("deadline_status") == "rolling"
    passed = F.col("deadline") <= now
    unconfirmed = status.isin("open", "closing-soon") & ~rolling & (F.col("deadline").isNull() | (F.col("deadline_status") != "confirmed"))
    return F.array_compact(F.array(
        F.when(~status.isin("verified", "open", "closing-soon"), "status-not-public"),
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "missing-title"),
        F.when(missing_organizer(), "missing-organizer"),
        F.when(~official_page(url, url_status), "no-verified-official-page"),
        F.when(F.col("has_conflict"), "unresolved-conflict"),
        F.when(passed, "deadline-passed").when(unconfirmed, "deadline-not-confirmed"),
        F.when((status == "closing-soon") & F.col("deadline").isNull(), "closing-soon-without-deadline"),
        F.when(team_only(), "team-only-source")))


def days_between(later: Column, earlier: Column) -> Column:
    """Days as a fraction."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


def triage(now: Column) -> Column:
    """(archive, score, flags) of a record (fixed weights)."""
    rolling = F.coalesce(F.col("deadline_status") == "rolling", F.lit(False))
    gone = F.coalesce((days_between(F.col("deadline"), now) < -2) & ~rolling, F.lit(False))
    closed = F.col("status") == "closed"
    strict, loose = blockers(F.lit("open"), now), blockers(F.lit("verified"), now)
    publishable, open_too = F.size(loose) == 0, (F.size(loose) == 0) & (F.size(strict) == 0)
    days = days_between(F.col("deadline"), now)
    future = F.coalesce(days > 0, F.lit(False)) & ~rolling
    undated = F.col("deadline").isNull() & ~rolling
    generic = F.coalesce(F.col("review_reason").contains("false-positive candidate"), F.lit(False))
    facts = [F.col("deadline").isNotNull() | rolling, F.col("max_runtime_minutes").isNotNull(), F.col("ai_policy") != "unclear", F.col("entry_fee_amount").isNotNull(), F.col("application_url").isNotNull(), F.col("eligibility").isNotNull()]
    points = (
        when(publishable, 40) + when(open_too, 15) - when(F.col("has_conflict"), 10) + F.when(future & (days <= 45), 15).when(future & (days <= 90), 8).otherwise(0)
        + sum((when(f, 3) for f in facts[1:]), when(facts[0], 3)) + F.floor(F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0)) * 10 + 0.5) - when(generic, 30)
    )
    flags = F.array_compact(F.array(
        F.when(team_only(), "team-only"), F.when(publishable, "publishable"), F.when(F.array_contains(loose, "no-verified-official-page"), "needs-official-url"),
        F.when(F.array_contains(loose, "missing-organizer"), "missing-organizer"), F.when(F.col("has_conflict"), "conflict"), F.when(undated, "needs-deadline"),
        F.when(future & (days <= 14), "closing-soon"), F.when(generic, "generic-page")))
    score = F.least(F.greatest(points, F.lit(0)), F.lit(100)).cast("int")
    archived = F.when(gone, "deadline-passed").when(closed, "closed")
    return F.struct(
        archived.alias("archive"), F.when(archived.isNotNull(), 0).otherwise(score).alias("score"),
        F.when(gone, F.array(F.lit("deadline-passed"))).when(closed, F.array(F.lit("closed"))).otherwise(flags).alias("flags"))


def value_score(now: Column) -> Column:
    """3 for AI, 2 for a prize, 1 if free, 1 if due within 30 days."""
    ai = (F.col("category") == "AI film festival") | F.col("ai_policy").isin("allowed", "required")
    days = days_between(F.col("deadline"), now)
    return (when(ai, 3) + when(F.col("prize_amount") > 0, 2) + when(F.col("entry_fee_amount") == 0, 1) + when((days >= 0) & (days <= 30), 1)).cast("int")


def poll_interval(outcome: Column, current: Column, failures: Column, finds: Column, changed: Column, idle: Column, least: Column, most: Column) -> Column:
    """The next polling interval: longer after failures and idle checks, shorter after finds (fixed factors)."""
    factor = (
        F.when(outcome == "failed", F.pow(F.lit(2.0), F.least(failures + 1, F.lit(5)))).when(finds >= 3, 0.5).when(finds >= 1, 0.7).when(changed, 0.85)
        .when(idle >= 8, 2.0).when(idle >= 3, 1.5).otherwise(1.15)
    )
    minutes = F.floor(current * factor + 0.5)
    return F.when(outcome == "blocked", most).otherwise(F.least(F.greatest(minutes, least), most)).cast("int")


def query_score(priority: Column, validated: Column, candidates: Column, new_sources: Column, runs: Column, gap: Column, cost: Column, slot: int, index: Column) -> Column:
    """The adaptive score of a search query (fixed weights)."""
    one = lambda c: F.greatest(c, F.lit(1)).cast("double")
    jitter = F.pmod(F.lit(slot) + F.lit(17) * index, F.lit(101)) / 10000
    return when(priority, 2.0) + validated * 5 / one(candidates) + new_sources * 3 / one(runs) + gap * 4 + F.lit(2.0) / F.sqrt(runs + 1) - F.least(F.lit(4.0), cost * 20 / one(validated + new_sources)) + jitter


def budget_mode(spend: Column, target: Column, optional_stop: Column, budget: Column) -> Column:
    """normal, conserve, essential-only or stopped."""
    return F.when((budget <= 0) | (spend >= budget), "stopped").when(spend >= optional_stop, "essential-only").when(spend >= target, "conserve").otherwise("normal")


def limits(mode: Column, queries: Column, results: Column, llm: Column) -> Column:
    """Queries, results and LLM calls that a budget mode leaves."""
    return F.struct(
        F.when(mode.isin("stopped", "essential-only"), 0).when(mode == "conserve", F.least(queries, F.lit(2))).otherwise(queries).alias("queries"),
        F.when(mode.isin("stopped", "essential-only"), 1).when(mode == "conserve", F.least(results, F.lit(4))).otherwise(results).alias("results"),
        F.when(mode == "stopped", 0).when(mode == "essential-only", F.least(llm, F.lit(4))).when(mode == "conserve", F.least(llm, F.lit(12))).otherwise(llm).alias("llm"))


def token_cost(tokens_in: Column, tokens_out: Column, usd_in: float = 0.045, usd_out: float = 0.384) -> Column:
    """US dollars for tokens at prices per million."""
    return F.round((tokens_in * F.lit(usd_in) + tokens_out * F.lit(usd_out)) / F.lit(1_000_000.0), 6)


def link_class(url: Column, status: Column, http: Column) -> Column:
    """The audit's class of a link; the order of the tests matters."""
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "missing").when(~url.rlike(r"(?i)^https?://[^\s/]+"), "malformed")
        .when((status == "invalid") | http.isin(404, 410), "invalid").when((status == "unreachable") | (http >= 500), "unreachable").when(status == "verified", "verified")
        .when((status == "unchecked") & http.isNull(), "unchecked").when(http.isin(200, 301, 302, 307, 308), "verified-metadata-missing").otherwise("needs-review")
    )


def claim_priority(family: Column, source_type: Column, same_host: Column, path: Column, application_is_source: Column) -> Column:
    """The strength of a claim: the lower, the stronger (fixed values)."""
    return (
        F.when(family == "opportunity-directory", 80).when(source_type == "social", 300).when(source_type == "community", 250).when(source_type == "press", 180)
        .when(~same_host, 120).when(application_is_source, 10).when(path == "/", 40).otherwise(20)
    )


def stale() -> dict[str, Column]:
    """Conditions of the stale report that need no clock."""
    broken = F.col("source_url_status").isin("invalid", "unreachable") | F.col("official_url_status").isin("invalid", "unreachable")
    return {"broken_links": F.coalesce(broken, F.lit(False))}
