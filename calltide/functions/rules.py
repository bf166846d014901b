"""Rule functions on sources, pages, records and reviews, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from . import url as U
from .dates import valid_date
from .extract import java
from .scoring import days_between

#: Families of sources by what names and hosts say, the first that matches (fixed patterns); the last argument is whether a second pattern must match too.
FAMILIES = [
    ("structured-festival", r"festival (?:directory|submission platform|catalog(?:ue)?)", None),
    ("opportunity-directory", r"opportunit|open[ -]?calls?|convocatori|bandi|ausschreibung|公募|공모", r"director|listing|portal|network|mobility|artist"),
    ("film-funding", r"film commission|film institute|arts council|film fund|public fund|funding|grant|fondo|fundo|fonds|förder|est[ií]mulo|edital", None),
    ("media-art-residency", r"residen|media art|moving image|video art|new media|digital art|biennial|museum", None),
    ("ai-creative-tech", r"generative|creative tech|artificial intelligence|\bai\b|人工智能|인공지능", None),
    ("platform-company", r"platform|creator challenge|developer challenge", None),
    ("news-feed", r"rss|atom feed|news feed", None),
    ("arts-institution", r"museum|foundation|cultural cent(?:re|er)|university|academy", None),
]
#: Categories that a text names, all that match (fixed patterns).
CATEGORIES = [
    ("ai-film", r"\bai\b|artificial intelligence|generative (?:film|video)"), ("short-film", r"short film|cortometr|court m[eé]trage|curta[- ]metragem"), ("animation", r"animat|anime|animação|animaci[oó]n"), ("music-video", r"music video|videoclip|clip musical"),
    ("experimental-new-media", r"experimental|moving image|media art|video art|new media|digital art"), ("grant", r"grant|funding|film fund|fondo|fonds|fundo|förder|est[ií]mulo|edital"), ("residency", r"residen|artist[- ]in[- ]residence"), ("lab-fellowship", r"\blab\b|laborator|fellowship|mentorship|incubator"),
    ("branded-open-call", r"brand(?:ed)? (?:challenge|content)|advertising competition|commission"), ("platform-challenge", r"platform (?:challenge|competition)|creator challenge|hackathon"), ("film-festival", r"film festival|festival de cine|festival de cinema|filmfest"),
]


def source_family(text: Column, url: Column) -> Column:
    t = F.lower(text)
    out = F.when(F.coalesce(U.raw_host(url), F.lit("")).rlike("filmfreeway|festhome|shortfilmdepot"), "structured-festival")
    for name, one, two in FAMILIES:
        hit = t.rlike(java(one))
        out = out.when(hit & t.rlike(java(two)) if two else hit, name)
    return out.otherwise("official-site")


def source_categories(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.lower(text).rlike(java(p)), n) for n, p in CATEGORIES]))


def source_policy(priority: Column, poll: Column, least: Column, most: Column) -> Column:
    """Clamped policy of a source: priority 1 to 4 (3 if missing), 15 <= least <= poll <= most <= 525600 minutes; and what was wrong."""
    p = F.least(F.greatest(F.coalesce(priority, F.lit(3)), F.lit(1)), F.lit(4))
    low = F.least(F.greatest(F.coalesce(least, F.lit(360)), F.lit(15)), F.lit(525_600))
    high = F.least(F.greatest(F.coalesce(most, F.lit(43_200)), low), F.lit(525_600))
    middle = F.least(F.greatest(F.coalesce(poll, F.lit(4_320)), low), high)
    errors = F.array_compact(F.array(F.when(priority.isNotNull() & ~priority.between(1, 4), "priority"), F.when(least < 15, "min_poll"), F.when(most < least, "max_poll"), F.when((poll < least) | (poll > most), "poll")))
    return F.struct(p.alias("priority"), low.alias("min_poll"), middle.alias("poll"), high.alias("max_poll"), errors.alias("errors"))


def validated(url: Column, final: Column, status: Column) -> Column:
    """(url, status): the final URL of a redirect, nothing for an invalid one."""
    return F.struct(F.when(status == "invalid", None).when(status == "redirected", F.coalesce(final, url)).otherwise(url).alias("url"), F.when(url.isNull(), "missing").otherwise(status).alias("status"))


def entity_keys(title: Column, organizer: Column, year: Column, official: Column) -> Column:
    """Keys of organizer, series and edition; null where the evidence is missing."""
    o, s = T.identity_text(organizer), T.series_key(title)
    known = (o != "") & ~o.isin("unknown", "unknown organizer") & official.isNotNull()
    org = F.when(known, F.sha2(F.concat(F.lit("organizer|"), o, F.lit("|"), U.base_domain(U.host(official))), 256))
    series = F.when(org.isNotNull() & (s != ""), F.sha2(F.concat_ws("|", F.lit("series"), org, s), 256))
    return F.struct(org.alias("organizer"), series.alias("series"), F.when(series.isNotNull() & year.isNotNull(), F.sha2(F.concat_ws("|", F.lit("edition"), series, year.cast("string")), 256)).alias("edition"))


def observed_status(open_quote: Column, closed_quote: Column) -> Column:
    """open or closed if only one of them is stated."""
    a, b = T.squeeze(F.coalesce(open_quote, F.lit(""))) != "", T.squeeze(F.coalesce(closed_quote, F.lit(""))) != ""
    return F.when(a & ~b, "open").when(b & ~a, "closed")


def official_site(results: DataFrame, series: str) -> DataFrame:
    """The best-ranked result of each series that is no platform, whose site names the series and that shares 0.6 of its words."""
    wanted = T.tokens(T.series_key(F.col(series)))
    h = U.host(F.col("url"))
    label = F.regexp_replace(h, "[^a-z0-9]", "")
    have = F.array_union(T.tokens(T.series_key(F.col("title"))), T.tokens(T.series_key(F.regexp_replace(h, "[.-]", " "))))
    shared = F.size(F.filter(wanted, lambda t: F.array_contains(have, t) | label.contains(t)))
    site = F.regexp_replace(F.regexp_replace(h, r"\.[^.]*$", ""), "[^a-z0-9]", "")
    short = T.initials(F.col(series))
    ok = (F.size(wanted) > 0) & ~U.is_platform(h) & T.names_host(site, wanted, F.substring(short, 1, 5)) & F.when(F.size(wanted) == 1, label.contains(wanted[0])).otherwise(shared / F.size(wanted) >= 0.6)
    return results.where(F.coalesce(ok, F.lit(False))).groupBy(series).agg(F.min_by("url", F.struct("rank", "url")).alias("site"))


def official_candidates(links: DataFrame, page_id: str, limit: int = 2) -> DataFrame:
    """Of each directory page up to ``limit`` official sites, one per domain: structured data first, then labelled links, then by place."""
    h = U.host(F.col("url"))
    rows = links.where(~U.is_platform(h)).withColumn("domain", U.base_domain(h))
    order = [F.when(F.col("kind") == "json-ld", 0).otherwise(1), F.col("position")]
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(page_id, "domain").orderBy(*order))).where("rn = 1")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(page_id).orderBy(*order, "domain"))).where(F.col("rank") <= limit).select(page_id, "domain", "url", "rank")


def is_detail(url: Column, base: Column) -> Column:
    """A page of one item of a directory: the same host, two path segments or more, no listing."""
    p = U.path(url)
    return F.coalesce((U.host(url) == U.host(base)) & (F.size(F.filter(F.split(p, "/"), lambda s: s != "")) >= 2) & ~p.rlike(r"(?i)/(?:page|category|tag|search|login|about)(?:/|$)"), F.lit(False))


def listing_cards(html: Column) -> Column:
    """The cards of a listing: (id, text) for each `/festival/<id>` link."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*/festival/[0-9]+[^>]*>.*?</a>)"), 1)
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, "/festival/([0-9]+)", 1).cast("bigint").alias("id"), T.squeeze(F.regexp_replace(a, "<[^>]+>", " ")).alias("text")))


def topics(results_json: Column) -> Column:
    """Topics of a portal's search results: identifier, title, sorted distinct deadlines and the status inside a JSON text."""
    schema = "struct<results: array<struct<metadata: struct<identifier: string, title: string, deadlines: array<string>, actions: array<string>>>>>"
    r = F.from_json(results_json, schema)["results"]
    status = lambda m: F.get_json_object(m["actions"][0], "$.status")
    return F.transform(r, lambda x: F.struct(x["metadata"]["identifier"].alias("id"), x["metadata"]["title"].alias("title"), F.array_sort(F.array_distinct(x["metadata"]["deadlines"])).alias("deadlines"), status(x["metadata"]).alias("status")))


def central_european_time(text: Column) -> Column:
    """`12th March 2026, 5:00 pm CET` as a UTC time; CEST is two hours ahead, CET one."""
    p = r"(?i)([0-9]{1,2})(?:st|nd|rd|th)?\s+([a-z]+)\s+([0-9]{4}),?\s+(?:at\s+)?([0-9]{1,2})[:.]([0-9]{2})\s*(am|pm)?\s*\(?(CEST|CET)"
    from .dates import month_number

    g = lambda i: F.regexp_extract(text, p, i)
    day = valid_date(g(3), month_number(g(2)), g(1))
    hour = g(4).try_cast("int") % 12 + F.when(F.lower(g(6)) == "pm", 12).otherwise(0)
    hour = F.when(g(6) == "", g(4).try_cast("int")).otherwise(hour)
    offset = F.when(F.upper(g(7)) == "CEST", 2).otherwise(1)
    return F.when(day.isNotNull() & (hour < 24), day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour - offset, g(5).try_cast("int")))


def parse_field(value: Column, kind: str) -> Column:
    """(value, error) of a form field: texts are trimmed, empty ones are null; numbers, dates and yes or no are checked."""
    t = F.when(F.trim(value) != "", F.trim(value))
    out = {"text": t, "number": t.try_cast("double").cast("string"), "date": t.try_cast("date").cast("string"), "flag": F.when(t.isin("true", "false"), t)}[kind]
    return F.struct(out.alias("value"), F.when(t.isNotNull() & out.isNull(), F.lit(f"not a {kind}")).alias("error"))


def fact_line(now: Column) -> Column:
    """The facts of a call in a line."""
    days = F.ceil(days_between(F.col("deadline"), now)).cast("int")
    due = F.when(F.col("deadline_status") == "rolling", "rolling").when(F.col("deadline").isNotNull(), F.concat(F.lit("due in "), days.cast("string"), F.lit(" days")))
    money = lambda c: F.format_string("%d", F.col(c).cast("bigint"))
    fee = F.when(F.col("entry_fee_amount") == 0, "free").when(F.col("entry_fee_amount").isNotNull(), F.concat(F.lit("fee "), money("entry_fee_amount")))
    return F.concat_ws(" · ", "category", due, fee, F.when(F.col("prize_amount") > 0, F.concat(F.lit("prize "), money("prize_amount"))))


def dead_domain(outcomes: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Keys whose last two outcomes are both DNS failures."""
    w = Window.partitionBy(key).orderBy(*order)
    last = outcomes.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    return last.groupBy(key).agg((F.count_if(F.col("outcome") == "DNS_NOT_FOUND") == 2).alias("blocked"))


def populate(record: Column, changes: Column, fields: list[str]) -> Column:
    """A record with the changed fields; an explicit null in the changes overwrites, a missing key does not."""
    has = lambda f: F.array_contains(F.json_object_keys(changes), f)
    return F.struct(*[F.when(F.coalesce(has(f), F.lit(False)), F.get_json_object(changes, f"$.{f}")).otherwise(record[f].cast("string")).alias(f) for f in fields])


def candidate_union(known: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """Candidates by canonical URL, the known ones first; provenance of all hits; the first ``limit`` by place."""
    both = known.withColumn("side", F.lit(0)).unionByName(found.withColumn("side", F.lit(1))).withColumn("url", U.canonical(F.col("url"))).where("url is not null")
    g = both.groupBy("url").agg(F.min(F.struct("side", "position", "title")).alias("first"), F.count("*").alias("hits"))
    return g.orderBy("first.side", "first.position", "url").limit(limit).select("url", "first.title", "hits", (F.col("first.side") == 0).alias("known"))
