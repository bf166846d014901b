"""Queries of record builders, grounding and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import html as H
from ..functions import records as R
from ..functions import text as T
from ..functions import url as U
from .base import NOW, OPPORTUNITIES, moment, opportunities, query, table


@query(f"""WITH {OPPORTUNITIES} SELECT id, CASE id % 4 WHEN 0 THEN 'Festhome' WHEN 1 THEN 'FilmFreeway' END AS platform, coalesce(regexp_matches(official_url, '^https?://(?:[^/]+\\.)?filmfreeway\\.com/[^/?#]+'), false) AS platform_link,
coalesce(application_url IS NOT NULL OR official_url LIKE 'https://filmfreeway.com/%', false) AS any_link, CASE WHEN official_url NOT LIKE 'https://filmfreeway.com/%' THEN regexp_extract(official_url, '^(https?://[^/]+/)', 1) END AS origin FROM opportunities""")
def platform_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U13 U15 HT11 M-16: platforms by tag and link, and origins as sources."""
    rows = opportunities(spark, sf_dir, "id", "official_url", "application_url")
    tags = F.when(F.col("id") % 4 == 0, "short,via-festhome").when(F.col("id") % 4 == 1, "via-filmfreeway").otherwise("x")
    urls = F.array_compact(F.array("official_url", "application_url"))
    return rows.select("id", R.platform_of(tags).alias("platform"), R.festival_platform_link(F.col("official_url")).alias("platform_link"), R.has_platform_link(urls).alias("any_link"), R.origin_source(F.col("official_url")).alias("origin"))


@query("SELECT o_orderkey AS id, 'CREA-' || o_orderkey::VARCHAR AS topic, strftime(o_orderdate, '%Y-%m-%d') AS opens, strftime(o_orderdate, '%Y-%m-%d') AS closes FROM orders")
def portal_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U14 HT16: topic identifiers, and dates as epoch milliseconds or text."""
    k, d = F.col("o_orderkey").cast("string"), F.col("o_orderdate")
    url = F.concat(F.lit("https://ec.example.eu/topic-details/crea-"), k, F.lit("?x=1"))
    millis = (F.unix_micros(F.to_utc_timestamp(F.to_timestamp_ltz(F.date_format(d, "yyyy-MM-dd"), F.lit("yyyy-MM-dd")), F.lit("UTC"))) / 1000).cast("bigint").cast("string")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), R.topic_id(url).alias("topic"), R.grant_dates(millis).cast("string").alias("opens"), R.grant_dates(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).cast("string").alias("closes"))


_ITEM = "concat('Aurora ', c_mktsegment, ' Film Festival')"


@query(f"""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'GENERIC_TITLE' WHEN 1 THEN 'UNGROUNDED_TITLE' WHEN 2 THEN 'DEADLINE_PASSED' END AS code, CASE WHEN c_custkey % 5 > 2 THEN {_ITEM} END AS title, CASE WHEN c_custkey % 5 > 2 THEN c_name END AS organizer,
CASE WHEN c_custkey % 5 > 2 THEN 'Traditional festival' END AS category, CASE WHEN c_custkey % 5 > 2 THEN 'confirmed' END AS deadline_status, CASE WHEN c_custkey % 5 > 2 THEN 20.0::DOUBLE END AS fee, CASE WHEN c_custkey % 5 > 2 THEN 'https://aurora.org/call' END AS official_url FROM customer""")
def normalize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X13 X26 TX28 U6: raw items as records, or why not, with every fact grounded in its page."""
    k = F.col("c_custkey")
    name = F.expr(_ITEM)
    deadline = F.when(k % 5 == 2, "1998-01-05").otherwise("1999-01-05")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 5 == 0, "Late deadline 1999").when(k % 5 == 1, F.lit("Another Film Prize")).otherwise(name).alias("title"), F.col("c_name").alias("organizer"), F.lit(None).cast("string").alias("category"), deadline.alias("deadline"),
        F.lit("20").alias("fee"), F.lit("eur").alias("currency"), F.lit("/call").alias("official"), F.concat(name, F.lit(" Late deadline 1999")).alias("page_title"), F.concat(F.lit("Run by "), "c_name", F.lit(", deadline "), deadline).alias("page"),
        F.lit("https://aurora.org/home").alias("url"), F.array(F.lit("https://aurora.org/call/")).alias("links"))
    out = rows.withColumn("n", R.normalized(moment(NOW)))
    return out.select("id", "n.code", "n.record.title", "n.record.organizer", "n.record.category", "n.record.deadline_status", "n.record.fee", "n.record.official_url")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '1998-11-0' || (1 + o_orderkey % 9)::VARCHAR END AS yearless, o_orderkey % 3 <> 0 AS matches FROM orders")
def yearless_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT7 DT8: deadlines whose year is left out, and evidence for deadlines."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Edition "), F.when(k % 2 == 0, "1998").otherwise("1997"), F.lit(". Deadline: "), (1 + k % 9).cast("string"), F.lit(" November, rules apply"))
    fixed = F.replace(text, F.lit("1998"), F.lit("1998"))
    quote = F.when(k % 3 == 0, "Opening on 5 October 2026").when(k % 3 == 1, "Deadline: 5 October 2026").otherwise("until October 5, 2026")
    # the year of this edition is of the nineties, which the general date forms do not read
    return table(spark, sf_dir, "orders").select(k.alias("id"), R.yearless_deadline(fixed, moment(NOW)).cast("string").alias("yearless"), R.deadline_matches(F.lit("2026-10-05"), quote).alias("matches"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Beta Prize' ELSE 'Alpha Lab' END AS name, CASE c_custkey % 3 WHEN 0 THEN 'film' WHEN 1 THEN 'other' ELSE 'none' END AS discipline FROM customer")
def nearest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX27 X23: whose date a quote is, and what a page is about."""
    k = F.col("c_custkey")
    text = F.when(k % 2 == 0, "Alpha Lab opens. Beta Prize deadline 5 May").otherwise("Beta Prize opens. Alpha Lab deadline 5 May")
    about = F.when(k % 3 == 0, "A documentary and poetry day").when(k % 3 == 1, "Poetry and ceramics").otherwise("Cats")
    return table(spark, sf_dir, "customer").select(k.alias("id"), R.nearest_name(text, F.lit("5 May"), F.lit("Alpha Lab"), F.array(F.lit("Beta Prize"))).alias("name"), X.discipline(about).alias("discipline"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'archive' WHEN 1 THEN CASE WHEN 1990 + o_orderkey % 12 < 1998 THEN 'edition' END END AS kind FROM orders")
def historical_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X27 JB3: links to archives and former editions."""
    k = F.col("o_orderkey")
    url = F.when(k % 3 == 0, "https://a.org/past-editions/").when(k % 3 == 1, F.concat(F.lit("https://a.org/e/"), (1990 + k % 12).cast("string"))).otherwise("https://a.org/now")
    return table(spark, sf_dir, "orders").select(k.alias("id"), R.historical_link(url, F.lit("see"), F.lit(1998)).alias("kind"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS page, 'https://x.org/' || repeat('a', (l_suppkey % 6)::INT) AS url, l_suppkey % 6 AS n, (l_suppkey % 6 * 7 % 4)::INT AS score FROM lineitem)
SELECT page, url, row_number() OVER (PARTITION BY page ORDER BY score DESC, n, url)::INT AS rank FROM l WHERE score > 0 QUALIFY rank <= 3""")
def hunt_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10 JB4: the three best links of a page, the shorter on ties."""
    n = F.col("l_suppkey") % 6
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.concat(F.lit("https://x.org/"), F.repeat(F.lit("a"), n.cast("int"))).alias("url"), (n * 7 % 4).cast("int").alias("s"))
    return R.hunt_links(links, "page", F.col("s")).select("page", "url", "rank")


@query("""SELECT conv_id AS series, substring(string_agg(text, chr(10) ORDER BY turn), 1, 500) AS text, array_to_string(list_sort(list_distinct(list(role))), ',') AS links FROM conversations GROUP BY conv_id""")
def series_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT18 X12: the pages of a series as one."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("series"), F.col("turn").alias("order"), "text", F.array("role").alias("links"))
    return R.series_pages(rows, "series", 500).withColumn("links", F.array_join("links", ","))


@query("""SELECT user_id, count(*) AS hops, arg_max(event_type, (rn)) FILTER (rn <= 6) AS final, count(*) > 6 AS too_many FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) GROUP BY user_id""")
def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10: chains of redirects with their final URL."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.lit(301).alias("status"), F.lit("x").alias("from"), F.col("event_type").alias("to"))
    return R.redirects(e, "user_id")


@query("SELECT page_id, 2 AS urls, url AS first FROM pages")
def config_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JM13: URLs anywhere in a configuration."""
    conf = F.to_json(F.struct(F.struct(F.struct(F.col("url").alias("u")).alias("deep"), F.lit("no").alias("n")).alias("a"), F.array(F.lit("https://b.org/"), F.col("url")).alias("list")))
    return table(spark, sf_dir, "pages").select("page_id", R.config_urls(conf).alias("u")).select("page_id", F.size("u").alias("urls"), F.col("u")[0].alias("first"))


@query("SELECT c_custkey AS id, c_mktsegment AS segment, NULL::VARCHAR AS missing FROM customer")
def legacy_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1 SC2 SC3 JM14: scans that fall back to other columns where a table lacks one."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), R.with_fallback(c, "segment", "c_mktsegment"), R.with_fallback(c, "missing", "gone").cast("string").alias("missing"))


@query("SELECT page_id, substring(regexp_extract(t, '(.{0,40}the.{0,40})'), 1, 10) <> '' AS quoted FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t FROM pages)")
def quotes_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX25 TX26: quotes around a match."""
    t = F.regexp_replace("html", "<[^>]+>", " ")
    return table(spark, sf_dir, "pages").select("page_id", (F.coalesce(T.quote_around(t, "the"), F.lit("")) != "").alias("quoted"))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, NULL::VARCHAR AS description, regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '\\.[^.]*$', '') <> '' AS labelled FROM pages")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT9 U12: meta values and site labels."""
    from ..functions.review import site_label

    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), H.meta(F.col("html"), "description").alias("description"), (site_label(F.col("url")) != "").alias("labelled"))


@query("SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' AS root, NOT regexp_matches(url, '^https?://(?:10\\.|127\\.|localhost)') AS safe FROM pages")
def site_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots and safety of URLs."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.origin(u).alias("root"), (~U.is_private(U.raw_host(u)) & U.safe(u).isNotNull()).alias("safe"))
