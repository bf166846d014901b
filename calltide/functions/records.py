"""Records out of raw items: grounding, normalisation, builders, links of archives, years that texts leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dates as D
from . import text as T
from . import url as U
from .extract import amount, category_for, currency, java

#: Names of platforms by tag (fixed values).
PLATFORM_TAGS = {"via-festhome": "Festhome", "via-filmfreeway": "FilmFreeway", "via-shortfilmdepot": "Shortfilmdepot"}
PLATFORM_LINKS = r"https?://(?:[^/]+\.)?(?:filmfreeway\.com/[^/?#]+|festhome\.com/f(?:estival)?/[^?#]+|shortfilmdepot\.com/[^?#]+)"
ARCHIVE = r"(?i)/(?:archive|archives|past-editions?|previous-editions?|edizioni|ediciones|palmares|history)(?:/|$)"


def platform_of(tags: Column) -> Column:
    """The platform that a `via-` tag names."""
    names = F.create_map(*[F.lit(x) for p in PLATFORM_TAGS.items() for x in p])
    return F.try_element_at(F.filter(F.transform(F.split(tags, ","), lambda t: F.try_element_at(names, t)), lambda x: x.isNotNull()), F.lit(1))


def festival_platform_link(url: Column) -> Column:
    """The link leads to a festival's page on a platform, not to the platform itself."""
    return F.coalesce(url.rlike("^" + PLATFORM_LINKS), F.lit(False))


def has_platform_link(urls: Column) -> Column:
    return F.exists(urls, festival_platform_link)


def topic_id(url: Column) -> Column:
    """The identifier of a portal's topic page."""
    x = F.regexp_extract(url, r"(?i)/topic-details/([a-z0-9-]+)", 1)
    return F.when(x != "", F.upper(x))


def grounded_fact(value: Column, title: Column, page: Column, quote: Column) -> Column:
    """The value stands in the title or page, or its quote in the page."""
    v = F.lower(T.clean(value, 500))
    hay = F.lower(F.concat_ws("\n", title, page))
    return (v != "") & (hay.contains(v) | T.contains_evidence(page, quote))


def normalized(now: Column) -> Column:
    """(code, record) of a raw item on its page (title, organizer, category, deadline, fee, currency, official, page_title, page, url, links): the first reason to reject it, and its record."""
    c = F.col
    title, category = T.clean(c("title"), 180), category_for(c("category"), c("title"), F.lit(""))
    official = U.canonical(U.resolve(c("official"), c("url")))
    official = F.when(U.grounded(official, F.concat(c("links"), F.array("url"))), official)
    deadline = F.when(F.lower(c("page")).contains(F.lower(c("deadline"))), D.normalize_deadline(c("deadline"), now))
    fee = amount(c("fee"))
    organizer = F.when(grounded_fact(c("organizer"), c("page_title"), c("page"), F.lit("")), T.clean(c("organizer"), 160)).otherwise("Unknown organizer")
    code = (
        F.when(title == "", "MISSING_TITLE").when(T.is_generic_title(title), "GENERIC_TITLE").when(category.isNull(), "UNSUPPORTED_CATEGORY")
        .when(~grounded_fact(c("title"), c("page_title"), c("page"), F.lit("")), "UNGROUNDED_TITLE").when(deadline < now, "DEADLINE_PASSED")
    )
    status = F.when(deadline.isNotNull(), "confirmed").otherwise("unknown")
    record = F.struct(title.alias("title"), organizer.alias("organizer"), category.alias("category"), deadline.alias("deadline"), status.alias("deadline_status"), fee.alias("fee"), F.when(fee > 0, currency(c("currency"))).alias("currency"), official.alias("official_url"), D.year_of(c("title"), c("deadline")).alias("year"))
    return F.struct(code.alias("code"), F.when(code.isNull(), record).alias("record"))


def yearless_deadline(text: Column, now: Column, within: int = 210) -> Column:
    """`deadline: 15 October` without its year: the next such day, if it is within ``within`` days and its year stands on the page."""
    p = rf"(?i)deadline[^0-9\n]{{0,30}}([0-9]{{1,2}})(?:st|nd|rd|th)?\s+({D.NAMES})(?!\.?,?\s+(?:de\s+)?20[0-9]{{2}})"
    month, day = D.month_number(F.regexp_extract(text, p, 2)), F.regexp_extract(text, p, 1)
    today = F.to_date(now)
    this, after = D.valid_date(F.year(now), month, day), D.valid_date(F.year(now) + 1, month, day)
    found = F.when(this >= today, this).otherwise(after)
    return F.when((F.datediff(found, today) <= within) & text.contains(F.year(found).cast("string")), found)


def deadline_matches(raw: Column, quote: Column) -> Column:
    """The quote has the deadline's year, month and day, and does not speak of openings alone."""
    d = F.try_element_at(D.mentions(raw), F.lit(1))
    opening = quote.rlike(java(r"\bopen(?:s|ing)?\b")) & ~quote.rlike(java(r"\b(?:deadline|clos|until|by)"))
    return F.coalesce(F.array_contains(D.mentions(quote), d) & ~opening, F.lit(False))


def nearest_name(text: Column, quote: Column, title: Column, siblings: Column) -> Column:
    """The title or sibling whose last mention before the quote is nearest to it (a title far behind another call's name loses)."""
    find = lambda a, b: F.call_function("instr", a, b)
    head = F.reverse(F.lower(F.substring(text, F.lit(1), F.greatest(F.lit(0), find(text, quote) - 1))))
    near = lambda n: F.struct(find(head, F.reverse(F.lower(n))).alias("at"), n.alias("name"))
    named = F.filter(F.transform(F.concat(F.array(title), siblings), near), lambda x: x["at"] > 0)
    return F.array_min(named)["name"]


def historical_link(url: Column, text: Column, year: Column) -> Column:
    """archive, edition or nothing: what a link says about former editions."""
    old = F.regexp_extract(F.concat_ws(" ", url, text), "(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1).try_cast("int")
    return F.when(U.path(url).rlike(ARCHIVE), "archive").when(old < year, "edition")


def hunt_links(links: DataFrame, page_id: str, score: Column, k: int = 3) -> DataFrame:
    """The ``k`` best links of a page: the score, then the shorter URL."""
    keyed = links.withColumns({"score": score, "key": U.match_key(F.col("url"))}).where("score > 0")
    best = keyed.groupBy(page_id, "key").agg(F.max_by(F.struct("url", "score"), F.struct("score", -F.length("url"))).alias("b")).select(page_id, "b.*")
    w = Window.partitionBy(page_id).orderBy(F.desc("score"), F.length("url"), "url")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def series_pages(pages: DataFrame, series: str, most: int = 200_000) -> DataFrame:
    """The pages of a series as one: their texts in order (pages without one last) up to ``most`` characters, missing without any, and the distinct links of all of them."""
    w = Window.partitionBy(series).orderBy(F.asc_nulls_last("order"))
    before = F.sum(F.coalesce(F.length("text") + 1, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # pages that begin beyond the text's end are not gathered; of one that begins right there, the line end before it counts
    numbered = pages.select(series, "text", F.row_number().over(w).alias("rn"), F.coalesce(before, F.lit(0)).alias("before"))
    texts = numbered.groupBy(series).agg(F.array_sort(F.collect_list(F.when(F.col("before") <= most, F.struct("rn", "text")))).alias("t"), F.count("text").alias("n"))
    links = pages.select(F.col(series).alias("of"), F.explode_outer("links").alias("link")).groupBy("of").agg(F.array_sort(F.collect_set("link")).alias("links"))
    return texts.join(links, F.col(series).eqNullSafe(F.col("of"))).select(series, F.when(F.col("n") > 0, F.substring(F.array_join("t.text", "\n"), 1, most)).alias("text"), "links")


def config_urls(config_json: Column) -> Column:
    """The http(s) URLs in a JSON configuration, at any depth, in their order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(config_json, F.lit("")), F.lit(r'"(https?://[^"\\]+)"'), 1))


def redirects(hops: DataFrame, key: str, most: int = 6) -> DataFrame:
    """Chains of hops (status, from, to) in order, with the final URL and whether there were too many."""
    g = hops.groupBy(key).agg(F.count("*").alias("hops"), F.slice(F.array_sort(F.collect_list(F.struct("seq", "status", "from", "to"))), 1, most).alias("chain"))
    return g.select(key, "hops", F.element_at("chain", -1)["to"].alias("final"), (F.col("hops") > most).alias("too_many"))


def with_fallback(rows: DataFrame, column: str, *others: str) -> Column:
    """The first of the columns that the table has."""
    known = [c for c in (column, *others) if c in rows.columns]
    return (F.coalesce(*known) if known else F.lit(None)).alias(column)


def grant_dates(text: Column) -> Column:
    """Epoch milliseconds or ISO text as a date."""
    millis = F.when(text.rlike("^[0-9]{12,13}$"), F.to_date(F.timestamp_millis(text.try_cast("bigint"))))
    return F.coalesce(millis, F.substring(text, 1, 10).try_cast("date"))


def origin_source(url: Column) -> Column:
    """The site of an official URL as a source, unless it is a platform's."""
    return F.when(~U.is_platform(U.host(url)), U.origin(url))
