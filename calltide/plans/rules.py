"""Queries of rule functions on sources, pages, records and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import html as H
from ..functions import review, rules
from ..functions import text as T
from ..functions.extract import json_objects
from ..operators import state
from .base import NOW, OPPORTUNITIES, SOURCES, moment, opportunities, query, sources, table
from .text import series_sql


@query(f"""WITH {SOURCES}, t AS (SELECT id, lower(concat(name, ' ', CASE id % 7 WHEN 0 THEN 'Open Calls Portal' WHEN 1 THEN 'Film Fund' WHEN 2 THEN 'AI Residency' WHEN 3 THEN 'Short Film Festival' WHEN 4 THEN 'University' WHEN 5 THEN 'Creator Challenge' ELSE 'x' END)) AS t FROM sources)
SELECT id, CASE id % 7 WHEN 0 THEN 'opportunity-directory' WHEN 1 THEN 'film-funding' WHEN 2 THEN 'media-art-residency' WHEN 3 THEN 'official-site' WHEN 4 THEN 'arts-institution' WHEN 5 THEN 'platform-company' ELSE 'official-site' END AS family,
CASE id % 7 WHEN 1 THEN 'grant' WHEN 2 THEN 'ai-film,residency' WHEN 3 THEN 'short-film,film-festival' WHEN 5 THEN 'platform-challenge' ELSE '' END AS categories FROM t""")
def source_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families and categories of sources."""
    label = F.expr("CASE id % 7 WHEN 0 THEN 'Open Calls Portal' WHEN 1 THEN 'Film Fund' WHEN 2 THEN 'AI Residency' WHEN 3 THEN 'Short Film Festival' WHEN 4 THEN 'University' WHEN 5 THEN 'Creator Challenge' ELSE 'x' END")
    s = sources(spark, sf_dir, "id", "name", "url").withColumn("t", F.concat_ws(" ", "name", label))
    return s.select("id", rules.source_family(F.col("t"), F.col("url")).alias("family"), F.array_join(rules.source_categories(F.col("t")), ",").alias("categories"))


@query("""WITH p AS (SELECT c_custkey AS id, (c_custkey % 7)::INT AS p, (c_custkey % 50 * 1000)::INT AS poll, (c_custkey % 40)::INT AS low, (c_custkey % 30 * 2000)::INT AS high FROM customer), q AS (SELECT *, least(greatest(low, 15), 525600) AS l FROM p), r AS (SELECT *, least(greatest(high, l), 525600) AS h FROM q)
SELECT id, least(greatest(p, 1), 4) AS priority, l AS min_poll, least(greatest(poll, l), h) AS poll, h AS max_poll, array_to_string(list_filter([CASE WHEN p NOT BETWEEN 1 AND 4 THEN 'priority' END, CASE WHEN low < 15 THEN 'min_poll' END, CASE WHEN high < low THEN 'max_poll' END, CASE WHEN poll < low OR poll > high THEN 'poll' END], lambda x: x IS NOT NULL), ',') AS errors FROM r""")
def source_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped policies and their errors."""
    k = F.col("c_custkey")
    p = rules.source_policy((k % 7).cast("int"), (k % 50 * 1000).cast("int"), (k % 40).cast("int"), (k % 30 * 2000).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), p.alias("p")).select("id", "p.priority", "p.min_poll", "p.poll", "p.max_poll", F.array_join("p.errors", ",").alias("errors"))


@query(f"WITH {OPPORTUNITIES} SELECT id, CASE official_url_status WHEN 'invalid' THEN NULL WHEN 'redirected' THEN source_url ELSE official_url END AS url, CASE WHEN official_url IS NULL THEN 'missing' ELSE official_url_status END AS status FROM opportunities")
def url_validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X19 JB14: validated URLs."""
    v = rules.validated(F.col("official_url"), F.col("source_url"), F.col("official_url_status"))
    return opportunities(spark, sf_dir, "id", "official_url", "source_url", "official_url_status").select("id", v.alias("v")).select("id", "v.url", "v.status")


@query(f"""WITH {OPPORTUNITIES}, s AS (SELECT id, {series_sql('title')} AS s, organizer, official_url FROM opportunities) SELECT id, official_url IS NOT NULL AND organizer <> 'unknown organizer' AS has_organizer, official_url IS NOT NULL AND organizer <> 'unknown organizer' AND s <> '' AS has_series FROM s""")
def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X20 ST13: which records have evidence for organizer and series."""
    rows = opportunities(spark, sf_dir, "id", "title", "organizer", "edition_year", "official_url")
    k = rules.entity_keys(F.col("title"), F.col("organizer"), F.col("edition_year"), F.col("official_url"))
    return rows.select("id", k.alias("k")).select("id", F.col("k.organizer").isNotNull().alias("has_organizer"), F.col("k.series").isNotNull().alias("has_series"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'open' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 THEN 'closed' END AS status FROM orders")
def observed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive signals."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), rules.observed_status(F.when(k % 2 == 0, "now open"), F.when(k % 3 == 0, "closed")).alias("status"))


@query("""WITH r AS (SELECT c_custkey % 40 AS n, c_custkey AS rank, CASE WHEN c_custkey % 3 = 0 THEN 'https://filmfreeway.com/x' WHEN c_custkey % 3 = 1 THEN 'https://www.aurora' || (c_custkey % 40)::VARCHAR || '.org/' || c_custkey::VARCHAR ELSE 'https://news.example.net/' || c_custkey::VARCHAR END AS url FROM customer)
SELECT 'Aurora' || n::VARCHAR || ' Film Festival' AS series, arg_min(url, rank) AS site FROM r WHERE url LIKE 'https://www.aurora%' GROUP BY n""")
def official_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U16 U17 HT12 JB16: a series' own site among ranked results."""
    k = F.col("c_custkey")
    n = (k % 40).cast("string")
    url = F.when(k % 3 == 0, "https://filmfreeway.com/x").when(k % 3 == 1, F.concat(F.lit("https://www.aurora"), n, F.lit(".org/"), k.cast("string"))).otherwise(F.concat(F.lit("https://news.example.net/"), k.cast("string")))
    results = table(spark, sf_dir, "customer").select(F.concat(F.lit("Aurora"), n, F.lit(" Film Festival")).alias("series"), k.alias("rank"), url.alias("url"), F.lit("Home").alias("title"))
    return rules.official_site(results, "series")


@query("""WITH l AS (SELECT l_orderkey AS page, l_linenumber AS position, 'x' || (l_suppkey % 5)::VARCHAR || '.org' AS domain, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS k, l_partkey FROM lineitem), u AS (SELECT page, domain, min(k * 1000 + position) AS o FROM l GROUP BY 1, 2)
SELECT page, domain, row_number() OVER (PARTITION BY page ORDER BY o, domain)::INT AS rank FROM u QUALIFY rank <= 2""")
def official_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U18 HT7 JB18: official sites of directory pages, one per domain."""
    links = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").agg(F.count("*").alias("n")).select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("position"), F.concat(F.lit("https://www.x"), (F.col("l_suppkey") % 5).cast("string"), F.lit(".org/a")).alias("url"), F.when(F.col("l_returnflag") == "R", "json-ld").otherwise("link").alias("kind"))
    return rules.official_candidates(links, "page").select("page", "domain", "rank")


@query("SELECT page_id, len(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), '/'), lambda s: s <> '')) >= 2 AND NOT regexp_matches(url, 'search') AS detail FROM pages")
def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of single items."""
    return table(spark, sf_dir, "pages").select("page_id", rules.is_detail(F.col("url"), F.col("url")).alias("detail"))


_MAP = "'<urlset><url><loc> ' || replace(url, '&', '&amp;') || ' </loc></url><url><loc>ftp://x</loc></url></urlset>'"


@query("SELECT page_id, url AS location FROM pages")
def sitemap_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC19 HT8: locations of sitemaps."""
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(_MAP).alias("xml"))
    return p.select("page_id", F.explode(H.sitemap_locations(F.col("xml"))).alias("location"))


@query("SELECT page_id, 'News & ' || page_id::VARCHAR AS title, url AS link FROM pages")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC20: items of feeds."""
    xml = F.concat(F.lit("<rss><item><title><![CDATA[News & "), F.col("page_id").cast("string"), F.lit("]]></title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link></item></rss>"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(H.feed_items(xml)).alias("i")).select("page_id", "i.title", "i.link")


@query("SELECT page_id, 'Fest ' || page_id::VARCHAR AS name, 'Org' AS organizer, '2026-10-0' || (1 + page_id % 9)::VARCHAR AS closes FROM pages")
def json_ld_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT5 HT6 JM1 JM2: events in JSON-LD."""
    k = F.col("page_id").cast("string")
    body = F.concat(F.lit('{"@type":"Event","name":"Fest '), k, F.lit('","organizer":{"name":"Org"},"offers":{"validThrough":"2026-10-0'), (1 + F.col("page_id") % 9).cast("string"), F.lit('"}}'))
    graph = F.concat(F.lit('{"@graph":['), body, F.lit("]}"))
    page = F.concat(F.lit('<script type="application/ld+json">'), F.when(F.col("page_id") % 2 == 0, body).otherwise(graph), F.lit("</script>"))
    return table(spark, sf_dir, "pages").select("page_id", H.json_ld_event(page).alias("e")).select("page_id", "e.name", "e.organizer", "e.closes")


@query("SELECT o_orderkey AS id, 'T-' || o_orderkey::VARCHAR AS topic, '1998-01-02,1999-05-06' AS deadlines, o_orderstatus AS status FROM orders")
def portal_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC22 HT15 JB20: topics of portal results, with JSON inside JSON."""
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit('{"results":[{"metadata":{"identifier":"T-'), k, F.lit('","title":"x","deadlines":["1999-05-06","1998-01-02","1999-05-06"],"actions":["{\\"status\\":\\"'), "o_orderstatus", F.lit('\\"}"]}}]}'))
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(rules.topics(text)).alias("t"))
    return t.select("id", F.col("t.id").alias("topic"), F.array_join("t.deadlines", ",").alias("deadlines"), "t.status")


@query("SELECT c_custkey AS page, c_custkey * 10 AS card, 'Fest ' || c_name AS label FROM customer")
def listing_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC21 HT4 HT13 HT14 JB19: cards of listings."""
    html = F.concat(F.lit('<div><a href="/x">no</a><a class="c" href="/festival/'), (F.col("c_custkey") * 10).cast("string"), F.lit('"><b>Fest</b> '), "c_name", F.lit("</a></div>"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.explode(rules.listing_cards(html)).alias("c")).select("page", F.col("c.id").alias("card"), F.col("c.text").alias("label"))


@query("SELECT o_orderkey AS id, 2 AS objects FROM orders")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC16 PF1: whole objects of truncated model answers."""
    text = F.concat(F.lit('```json\n[{"title":"a { b"},{"id":'), F.col("o_orderkey").cast("string"), F.lit('},{"title":"cut'))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.size(json_objects(text)).alias("objects"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate + INTERVAL 1 HOUR * CASE WHEN o_orderkey % 2 = 0 THEN 16 ELSE 15 END + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS utc, strftime(o_orderdate + INTERVAL 10 HOUR, '%Y-%m-%d %H:%M:%S') AS explicit, strftime(o_orderdate, '%Y-%m-%d') AS dotted FROM orders")
def time_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT2 DT16 DT17: CET and CEST times, explicit offsets, dotted dates."""
    d = F.col("o_orderdate")
    cet = F.concat(F.date_format(d, "d'th' MMMM yyyy"), F.lit(", 5:30 pm "), F.when(F.col("o_orderkey") % 2 == 0, "CET").otherwise("CEST"))
    iso = F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T12:00:00+02:00"))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fmt(rules.central_european_time(cet)).alias("utc"), fmt(D.explicit_time(iso)).alias("explicit"), D.day_month_year(F.date_format(d, "dd.MM.yyyy")).cast("string").alias("dotted"))


@query("WITH d AS (SELECT o_custkey, list(o_orderdate::DATE) AS l FROM orders GROUP BY 1) SELECT o_custkey, list_min(list_filter(l, lambda x: x >= DATE '1998-06-15'))::VARCHAR AS next FROM d")
def next_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT18 DT20: the first date that is not past."""
    days = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.to_date("o_orderdate")).alias("d"))
    return days.select("o_custkey", D.next_cutoff(F.col("d"), F.to_date(F.lit("1998-06-15"))).cast("string").alias("next"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'not a number' END AS error FROM orders""")
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-13 M-14: typed form fields with errors."""
    k = F.col("o_orderkey")
    s = rules.parse_field(F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderstatus")), "text")
    n = rules.parse_field(F.when(k % 4 == 0, "many").otherwise(k.cast("string")), "number")
    return table(spark, sf_dir, "orders").select(k.alias("id"), s["value"].alias("status"), n["error"].alias("error"))


@query(f"""WITH {OPPORTUNITIES} SELECT id, concat_ws(' · ', category, CASE WHEN deadline_status = 'rolling' THEN 'rolling' WHEN deadline IS NOT NULL THEN 'due in ' || ceil((epoch_us(deadline) - epoch_us(TIMESTAMP '{NOW}')) / 86400000000.0::DOUBLE)::INT::VARCHAR || ' days' END,
CASE WHEN entry_fee_amount = 0 THEN 'free' WHEN entry_fee_amount IS NOT NULL THEN 'fee ' || entry_fee_amount::BIGINT::VARCHAR END, CASE WHEN prize_amount > 0 THEN 'prize ' || prize_amount::BIGINT::VARCHAR END) AS facts FROM opportunities""")
def fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-15 DT14: the facts of each call in a line."""
    return opportunities(spark, sf_dir).select("id", rules.fact_line(moment(NOW)).alias("facts"))


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, count_if(event_type IN ('error', 'view')) = 2 AS blocked FROM r WHERE rn <= 2 GROUP BY user_id""")
def dead_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST22: two DNS failures in a row."""
    e = table(spark, sf_dir, "events").withColumn("outcome", F.when(F.col("event_type").isin("error", "view"), "DNS_NOT_FOUND").otherwise("ok"))
    return rules.dead_domain(e, "user_id", [F.desc("ts"), F.desc("event_id")])


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' WHEN c_custkey % 3 = 1 THEN NULL ELSE c_name END AS name, c_mktsegment AS segment FROM customer")
def populate_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JM3: changes over a record; an explicit null overwrites."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("r"), F.when(k % 3 == 0, '{"name":"new"}').when(k % 3 == 1, '{"name":null}').otherwise("{}").alias("changes"))
    return c.select("id", rules.populate(F.col("r"), F.col("changes"), ["name", "segment"]).alias("p")).select("id", "p.name", "p.segment")


@query("""WITH k AS (SELECT s_suppkey AS position, 'https://h' || (s_suppkey % 30)::VARCHAR || '.org/' AS url, 'known ' || s_suppkey::VARCHAR AS title FROM supplier WHERE s_suppkey % 5 = 0), f AS (SELECT p_partkey AS position, 'https://h' || (p_partkey % 45)::VARCHAR || '.org/' AS url, 'found ' || p_partkey::VARCHAR AS title FROM part),
u AS (SELECT 0 AS side, * FROM k UNION ALL SELECT 1, * FROM f), g AS (SELECT url, min(side) AS side, min(side * 1000000 + position) AS o, arg_min(title, side * 1000000 + position) AS title, count(*) AS hits FROM u GROUP BY url) SELECT url, title, hits, side = 0 AS known FROM g ORDER BY o, url LIMIT 40""")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by URL, known ones first, the first forty."""
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(s.alias("position"), F.concat(F.lit("HTTPS://H"), (s % 30).cast("string"), F.lit(".org/?utm_medium=a")).alias("url"), F.concat(F.lit("known "), s.cast("string")).alias("title"))
    found = table(spark, sf_dir, "part").select(p.alias("position"), F.concat(F.lit("https://h"), (p % 45).cast("string"), F.lit(".org#x")).alias("url"), F.concat(F.lit("found "), p.cast("string")).alias("title"))
    return rules.candidate_union(known, found, 40)


@query(f"""WITH {OPPORTUNITIES}, n AS (SELECT id, category AS organizer, date_trunc('month', deadline)::DATE AS day, array_to_string(list_sort(list_distinct(string_split({series_sql('title')}, ' '))), ' ') AS words FROM opportunities WHERE review_decision = 'approved' AND deadline IS NOT NULL)
SELECT organizer, day::VARCHAR AS day, words, count(*) AS n, min(id) AS keeper FROM n GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def published_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published duplicates by organizer, day and the set of name words."""
    rows = opportunities(spark, sf_dir, "id", "category", "deadline", "title", "review_decision").where("review_decision = 'approved' and deadline is not null")
    words = F.array_join(F.array_sort(F.array_distinct(F.split(T.series_key(F.col("title")), " "))), " ")
    return rows.groupBy(F.col("category").alias("organizer"), F.to_date(F.date_trunc("month", "deadline")).cast("string").alias("day"), words.alias("words")).agg(F.count("*").alias("n"), F.min("id").alias("keeper")).where("n > 1")


@query("SELECT o_custkey AS key, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS names, count(*) AS rows FROM orders GROUP BY 1")
def coverage_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 JB25: the truth per series."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("names"), F.count("*").alias("rows"))


@query("SELECT o_orderkey AS id, o_orderpriority AS name FROM orders WHERE o_orderkey % 10 = 3")
def golden_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 SC6 SC7: benchmark rows by their identifier."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.when(k % 10 == 3, "GBV-").otherwise("X-"), k.cast("string")).alias("code"), F.col("o_orderpriority").alias("name"))
    return rows.where(F.col("code").rlike("^GBV")).select("id", "name")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'released' ELSE 'reserved' END AS status FROM events")
def finalize_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST10: reservations take their outcome."""
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.lit("reserved").alias("status"))
    outcome = e.where("event_id % 3 <> 2").select("event_id", F.when(F.col("event_id") % 3 == 0, "succeeded").otherwise("released").alias("status"))
    return state.merge_rows(rows, outcome, "event_id").drop("action")


@query(f"WITH {OPPORTUNITIES} SELECT id, CASE WHEN category IN ('Traditional festival','Grant') AND regexp_matches(title, 'The AI Film Festival') THEN 'AI film festival' ELSE category END AS category FROM opportunities")
def name_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories that names correct."""
    return opportunities(spark, sf_dir, "id", "title", "organizer", "category").select("id", review.name_category(F.col("category"), F.col("title"), F.col("organizer")).alias("category"))


@query(f"WITH {OPPORTUNITIES} SELECT id, title || ' Prize' AS title FROM opportunities")
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX19: titles without site names, announcements and closing organizers."""
    rows = opportunities(spark, sf_dir, "id", "title", "organizer")
    raw = F.concat(F.lit("Call for entries "), "title", F.lit(" Prize - "), "organizer", F.lit(" | Site"))
    return rows.select("id", T.clean_title(raw, F.col("organizer")).alias("title"))


@query("SELECT page_id, 'Aurora ' || page_id::VARCHAR AS name, position FROM (SELECT page_id, 1 + page_id % 2 AS position FROM pages)")
def lead_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX22 TX23 JM10: names in news titles; places in arrays."""
    k = F.col("page_id")
    n = k.cast("string")
    title = F.when(k % 2 == 0, F.concat(F.lit('Festival "Aurora '), n, F.lit('" opens'))).otherwise(F.concat(F.lit("Aurora "), n, F.lit(" - The News")))
    return table(spark, sf_dir, "pages").select("page_id", T.lead_name(title).alias("name"), F.array_position(F.array(F.lit(0), F.lit(1)), (k % 2).cast("int")).alias("position"))


