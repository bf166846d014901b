"""HTML, link, sitemap, feed and JSON-LD functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .url import canonical, resolve

#: Patterns that speak for a link, against it, and those without which it is not followed (fixed values; in the catalogue's languages).
LINK_POSITIVE = [r"(?i)submi(?:t|ssion)", r"(?i)call[-_ ]for", r"(?i)open[-_ ]?call", r"(?i)appl(?:y|ication)", r"(?i)entr(?:y|ies)", r"(?i)deadline", r"(?i)regulation", r"(?i)rules", r"(?i)festival", r"(?i)competition", r"(?i)grant", r"(?i)residenc", r"(?i)award", r"(?i)convocatoria", r"(?i)bando", r"(?i)appel", r"(?i)ausschreibung", r"(?i)inscri"]
LINK_NEGATIVE = [r"(?i)privacy", r"(?i)cookie", r"(?i)(?:^|/)about(?:/|$)", r"(?i)(?:^|/)login(?:/|$)", r"(?i)(?:^|/)sign[-_]?in(?:/|$)", r"(?i)share=", r"(?i)\.(?:jpg|jpeg|png|gif|webp|svg|ico|mp4|mov|mp3|zip)(?:\?|$)"]
LINK_STRONG = LINK_POSITIVE[:6]


def plain_text(html: Column) -> Column:
    """The text of a page: without comments, scripts and tags, block ends as line ends, entities decoded."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript", "svg", "template"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?\s*>", "\n")
    t = F.regexp_replace(t, r"(?i)</(?:p|div|li|h[1-6]|section|article)>", "\n")
    t = T.decode(F.regexp_replace(t, "<[^>]+>", " "))
    t = F.regexp_replace(F.regexp_replace(t, r"[\t\f ]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def title(html: Column) -> Column:
    t = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(t != "", T.squeeze(T.decode(t)))


def heading(html: Column) -> Column:
    t = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.when(t != "", T.squeeze(T.decode(F.regexp_replace(t, "<[^>]+>", " "))))


def meta(html: Column, name: str) -> Column:
    """The content of a meta tag by name or property, in either order of attributes."""
    one = F.regexp_extract(html, rf"(?is)<meta[^>]+(?:name|property)=[\"']{name}[\"'][^>]+content=[\"']([^\"']*)[\"']", 1)
    two = F.regexp_extract(html, rf"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+(?:name|property)=[\"']{name}[\"']", 1)
    return F.coalesce(F.when(one != "", T.decode(one)), F.when(two != "", T.decode(two)))


def anchors(html: Column) -> Column:
    """The anchors of a page, in order, as (href, text)."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), 1)
    href = lambda a: F.regexp_extract(a, r"(?is)^<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    body = lambda a: F.substring(T.squeeze(T.decode(F.regexp_replace(a, "<[^>]+>", " "))), 1, 240)
    return F.filter(F.transform(found, lambda a: F.struct(href(a).alias("href"), body(a).alias("text"))), lambda a: a["href"] != "")


def links(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """(page_id, position, url, text): the canonical links of each page, each once, at its first place."""
    each = pages.select(page_id, F.col(url).alias("base"), F.posexplode(anchors(F.col(html))).alias("position", "a"))
    each = each.select(page_id, "position", canonical(resolve(F.col("a.href"), F.col("base"))).alias("url"), F.col("a.text").alias("text")).where("url is not null")
    return each.groupBy(page_id, "url").agg(F.min(F.struct("position", "text")).alias("m")).select(page_id, "m.position", "url", "m.text")


def sitemap_locations(xml: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*([^<]+?)\s*</loc>"), 1), T.decode), lambda u: u.rlike("(?i)^https?://"))


def feed_items(xml: Column) -> Column:
    """The items of a feed as (title, link, published)."""
    items = F.regexp_extract_all(xml, F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), 1)

    def field(item: Column, name: str) -> Column:
        raw = F.regexp_extract(item, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1)
        return T.squeeze(T.decode(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")))

    return F.transform(items, lambda i: F.struct(field(i, "title").alias("title"), field(i, "link").alias("link"), field(i, "pubDate").alias("published")))


def json_ld(html: Column) -> Column:
    """The JSON-LD blocks of a page that parse, as variants."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), 1)
    return F.filter(F.transform(raw, F.try_parse_json), lambda v: v.isNotNull())


def json_ld_event(html: Column) -> Column:
    """(name, organizer, url, closes) of the first block, at its top or the first of its @graph."""
    v = F.try_element_at(json_ld(html), F.lit(1))
    one = lambda p: F.coalesce(F.try_variant_get(v, f"$.{p}", "string"), F.try_variant_get(v, f"$['@graph'][0].{p}", "string"))
    return F.struct(one("name").alias("name"), one("organizer.name").alias("organizer"), one("url").alias("url"), one("offers.validThrough").alias("closes"))


def looks_like_shell(page_text: Column, n_links: Column) -> Column:
    """A page that scripts fill in: little text and few links."""
    return (F.length(page_text) < 600) & (n_links < 6)


def gate(status: Column, content_type: Column, page_text: Column) -> Column:
    """Why a fetched page is not read, null if it is."""
    return (
        F.when(status >= 400, "HTTP_ERROR").when(~F.lower(content_type).rlike("html|xhtml|plain"), "UNSUPPORTED_CONTENT_TYPE").when(F.length(page_text) < 80, "EMPTY_PAGE")
    )


def robots_allowed(path: Column, rules: Column) -> Column:
    """Whether a path is allowed by (allow, pattern) rules: the longest match decides, allow wins ties; `*` and a final `$` are known."""
    pattern = lambda p: F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(p, r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*"))
    hits = F.filter(rules, lambda r: (r["pattern"] != "") & F.regexp_like(path, pattern(r["pattern"])))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))
