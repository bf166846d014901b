"""Catalogue operators: filters, search, sort modes, pages, public view and review queue.

Every function takes a DataFrame of opportunities and returns a DataFrame; the
time is a parameter. Filters are plain predicates, so they reach the scan, and
pages sort with ``limit`` so that Spark keeps only the top rows of each task.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses that are listed, and those whose page can be looked up (fixed values).
LISTED = ["verified", "open", "closing-soon"]
PUBLISHED = [*LISTED, "closed"]
AI_POLICIES = ["allowed", "required"]
SORTS = ("urgent", "newest", "prize")
CLOSING_DAYS = (7, 14, 30)
SLUG = r"^[a-z0-9][a-z0-9-]{0,200}$"


def search_text(value: str | None) -> str:
    """A search parameter: NFKC, at most 80 characters, letters, numbers, spaces and hyphens only."""
    text = unicodedata.normalize("NFKC", value or "")[:80]
    text = "".join(c if c.isalpha() or c.isnumeric() or c in " -" else " " for c in text)
    return re.sub(r"\s+", " ", text).strip()


def bounded_int(value: str | None, least: int, most: int) -> int | None:
    """A parameter of digits only; below ``least`` it counts as missing, above ``most`` it is ``most``."""
    if value is None or not re.fullmatch(r"[0-9]+", value.strip()):
        return None
    n = int(value)
    return None if n < least else min(n, most)


def clamp_page(limit: int | None, offset: int | None) -> tuple[int, int]:
    """A page of 1 to 50 rows (24 if not given) from at most row 100,000."""
    return min(max(limit if limit is not None else 24, 1), 50), min(max(offset or 0, 0), 100_000)


@dataclass(frozen=True)
class Options:
    """Catalogue parameters, checked."""

    search: str | None = None
    category: str | None = None
    ai_policy: str | None = None
    ai_only: bool = False
    free_only: bool = False
    prize_only: bool = False
    closing_within: int | None = None
    sort: str = "urgent"
    limit: int = 24
    offset: int = 0

    def __post_init__(self) -> None:
        if self.sort not in SORTS:
            raise ValueError(f"sort is one of {SORTS}")
        if self.closing_within is not None and self.closing_within not in CLOSING_DAYS:
            raise ValueError(f"closing_within is one of {CLOSING_DAYS}")


def not_expired(now: Column) -> Column:
    """No deadline, a rolling one, or one not before the current hour."""
    return F.col("deadline").isNull() | (F.col("deadline_status") == "rolling") | (F.col("deadline") >= F.date_trunc("HOUR", now).cast("timestamp_ntz"))


def ai_related() -> Column:
    return (F.col("category") == "AI film festival") | F.col("ai_policy").isin(AI_POLICIES)


def matches(text: str, *columns: str) -> Column:
    """Any of the columns contains the (sanitised) text, whatever its case."""
    out = F.lit(False)
    for c in columns:
        out |= F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower())
    return out


def catalogue(rows: DataFrame, now: Column, options: Options = Options()) -> DataFrame:
    """The listed rows that the options leave."""
    out = rows.where(F.col("status").isin(LISTED) & not_expired(now))
    if text := search_text(options.search):
        out = out.where(matches(text, "title", "organizer", "summary", "location"))
    if options.ai_only:
        out = out.where(ai_related())
    if options.category:
        out = out.where(F.col("category") == options.category)
    if options.ai_policy:
        out = out.where(F.col("ai_policy") == options.ai_policy)
    if options.free_only:
        out = out.where(F.col("entry_fee_amount") == 0)
    if options.prize_only:
        out = out.where(F.col("prize_amount") > 0)
    if options.closing_within is not None:
        out = out.where(F.col("deadline") <= now + F.make_dt_interval(F.lit(options.closing_within)))
    return out


def ordering(sort: str) -> list[Column]:
    return {
        "urgent": [F.desc("featured"), F.asc_nulls_last("deadline"), F.asc("id")],
        "newest": [F.desc("discovered_at"), F.asc("id")],
        "prize": [F.desc_nulls_last("prize_amount"), F.asc("id")],
    }[sort]


def page(rows: DataFrame, options: Options) -> DataFrame:
    return rows.orderBy(*ordering(options.sort)).offset(options.offset).limit(options.limit)


def page_info(rows: DataFrame, options: Options) -> DataFrame:
    """total, offset, returned and has_more of a page, from one count."""
    total = rows.agg(F.count("*").alias("total"))
    returned = F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(options.limit).cast("bigint"), F.col("total") - options.offset))
    return total.select("total", F.lit(options.offset).alias("offset"), returned.alias("returned"), (F.col("total") > options.offset + returned).alias("has_more"))


def merge_pages(pages: DataFrame, key: str, page_no: str, position: str) -> DataFrame:
    """One row per key: the latest page's values at the place where the key first stood."""
    rest = [c for c in pages.columns if c not in (key, page_no, position)]
    out = pages.groupBy(key).agg(F.max_by(F.struct(*rest), page_no).alias("v"), F.min(F.struct(page_no, position)).alias("first"))
    return out.select(key, "v.*", F.col(f"first.{page_no}").alias("first_page"), F.col(f"first.{position}").alias("first_position"))


def quick_counts(rows: DataFrame, now: Column) -> DataFrame:
    """The five counts of the quick filters in one pass."""
    listed = rows.where(F.col("status").isin(LISTED) & not_expired(now))
    return listed.agg(
        F.count("*").alias("all_open"), F.count_if(ai_related()).alias("ai_only"), F.count_if(F.col("entry_fee_amount") == 0).alias("free"),
        F.count_if(F.col("prize_amount") > 0).alias("with_prize"), F.count_if(F.col("deadline") <= now + F.make_dt_interval(F.lit(30))).alias("closing_30"))


def public_view(rows: DataFrame) -> DataFrame:
    """What anybody may read: approved, verified and not waiting for review."""
    return rows.where((F.col("review_decision") == "approved") & ~F.col("review_required") & F.col("verified_at").isNotNull() & F.col("status").isin(LISTED))


def by_slug(rows: DataFrame, slug: str) -> DataFrame:
    if not re.fullmatch(SLUG, slug):
        return rows.limit(0)
    return rows.where((F.col("slug") == slug) & F.col("status").isin(PUBLISHED)).limit(1)


def review_queue(rows: DataFrame, view: str, flag: str | None = None) -> DataFrame:
    """Rows of a review view: human, pending, team, approved or rejected; optionally with a triage flag."""
    pending = F.col("review_decision") == "pending"
    team = F.col("tags").startswith("platform:festhome") | F.col("tags").startswith("festhome:")
    views = {"pending": pending, "human": pending & F.col("review_required") & ~team, "team": pending & team}
    out = rows.where(views.get(view, F.col("review_decision") == view))
    return out.where(F.array_contains("triage_flags", flag)) if flag else out


def before_workflow(rows: DataFrame) -> DataFrame:
    """What waits for review in tables from before there were decisions."""
    return rows.where(F.col("status").isin("signal", "discovered") | F.col("review_required"))


def refine(rows: DataFrame, text: str, view: str = "all", saved: DataFrame | None = None) -> DataFrame:
    """The client's filter: one haystack of all texts, then verified, signals or saved rows."""
    hay = F.lower(F.concat_ws(" ", "title", "organizer", "summary", "location", "category", "tags"))
    out = rows.where(hay.contains(text.lower())) if text else rows
    if view == "verified":
        out = out.where(F.col("status").isin("verified", "open", "closing-soon"))
    elif view == "signals":
        out = out.where(F.col("status").isin("signal", "discovered"))
    elif view == "saved" and saved is not None:
        out = out.join(saved, "id", "left_semi")
    return out


def authorized(email: Column, listed: str) -> Column:
    """The lower-cased address is on the comma list; an empty list lets nobody in."""
    known = [x.strip().lower() for x in listed.split(",") if x.strip()]
    return F.lower(F.trim(email)).isin(known) if known else F.lit(False)


def offending_keys(changes: Column, editable: list[str]) -> Column:
    """Keys of a change map that may not be edited, in order."""
    return F.array_sort(F.array_except(F.map_keys(changes), F.array(*map(F.lit, editable))))


def identity_email(header: Column) -> Column:
    """An address from an identity header, percent-decoded; null unless it has an @."""
    email = F.lower(F.trim(F.try_url_decode(header)))
    return F.when(email.contains("@"), email)


def mapped(rows: DataFrame) -> DataFrame:
    """Stored rows as the catalogue shows them: ids and texts, defaults for what is missing, fields of the payload (JSON) where the column is empty, and the links with their state."""
    c = F.col
    payload = lambda name: F.get_json_object("raw_payload", f"$.{name}")
    safe = lambda u: F.when(u.rlike(r"(?i)^https?://[^\s/]+"), u)

    def link(kind: str) -> Column:
        has = lambda name: c(f"{kind}_{name}") if f"{kind}_{name}" in rows.columns else F.lit(None).cast("string")
        url, status, http = safe(F.coalesce(has("url"), payload(f"{kind}_url"))), F.coalesce(has("url_status"), payload(f"{kind}_url_status"), F.lit("unchecked")), has("url_http_status").cast("int")
        verified = url.isNotNull() & status.isin("verified", "redirected") & F.coalesce(http.between(200, 399), F.lit(False))
        return F.struct(url.alias("url"), status.alias("status"), http.alias("http_status"), verified.alias("verified")).alias(kind)

    text = lambda name, default: F.coalesce(c(name).cast("string"), F.lit(default)).alias(name)
    return rows.select(
        c("id").cast("string").alias("id"), "slug", "title", "organizer", "category", "status", "ai_policy", "deadline", F.coalesce("deadline_status", payload("deadline_status"), F.lit("unknown")).alias("deadline_status"),
        safe(F.coalesce("deadline_source_url", payload("deadline_source_url"))).alias("deadline_source_url"), "opens_at", c("prize_amount").cast("double").alias("prize_amount"), c("entry_fee_amount").cast("double").alias("entry_fee_amount"), text("location", "Online"),
        c("max_runtime_minutes").cast("int").alias("max_runtime_minutes"), link("source"), link("official"), link("application"), text("source_type", "community"), F.coalesce(c("confidence").cast("double"), F.lit(0.0)).alias("confidence"), text("summary", ""),
        F.filter(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: t != "").alias("tags"), "discovered_at", "verified_at", F.coalesce("review_required", F.lit(False)).alias("review_required"), "review_decision", "review_reason", "readiness_score",
        F.coalesce("has_conflict", F.lit(False)).alias("has_conflict"), "previous_status", "previous_deadline", F.coalesce("featured", F.lit(False)).alias("featured"))
