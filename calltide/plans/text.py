"""Text, URL, HTML and date queries over pages, documents and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import html as H
from ..functions import text as T
from ..functions import url as U
from ..operators import ranking
from .base import NOW, OPPORTUNITIES, moment, opportunities, query, spread, table


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold_sql(x: str) -> str:
    a, b = T.fold_table()
    return f"regexp_replace(translate({x}, {_q(a)}, {_q(b)}), '\\p{{M}}+', '', 'g')"


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s ﻿]+', ' ', 'g'))"


def clean_sql(x: str, most: int = 300) -> str:
    return f"substring({squeeze_sql(f'coalesce({x}, {_q('')})')}, 1, {most})"


def identity_sql(x: str) -> str:
    t = f"lower({fold_sql(clean_sql(x, 500))})"
    t = f"regexp_replace({t}, '\\b(?:19|20)[0-9]{{2}}\\b', ' ', 'g')"
    t = f"regexp_replace({t}, '\\b[0-9]{{1,3}}(?:st|nd|rd|th|a|e|o)?\\s+(?:annual\\s+)?edition\\b', ' ', 'g')"
    return squeeze_sql(f"regexp_replace({t}, '[^a-z0-9\\p{{L}}\\p{{N}}]+', ' ', 'g')")


def match_sql(x: str) -> str:
    t = f"regexp_replace(replace(lower({fold_sql(x)}), '&', ' and '), '[’'']', '', 'g')"
    return squeeze_sql(f"regexp_replace({t}, '[^a-z0-9\\p{{L}}\\p{{N}}]+', ' ', 'g')")


def series_sql(x: str) -> str:
    t = fold_sql(f"lower({x})")
    for p in (r"\b(?:19|20)[0-9]{2}\b", r"\b[0-9]+(?:st|nd|rd|th|e|er|a|o|º|ª)?\b", r"[^\p{L}\p{N}]+", rf"\b(?:{'|'.join(T.SERIES_STOP)})\b"):
        t = f"regexp_replace({t}, '{p}', ' ', 'g')"
    return squeeze_sql(t)


def decode_sql(x: str) -> str:
    for p, r in T.ENTITIES:
        x = f"regexp_replace({x}, {_q(p[4:])}, {_q(r)}, 'gi')"
    return x


def plain_sql(x: str) -> str:
    t = f"regexp_replace({x}, '<!--.*?-->', ' ', 'gs')"
    for tag in ("script", "style", "noscript", "svg", "template"):
        t = f"regexp_replace({t}, '<{tag}\\b.*?</{tag}>', ' ', 'gis')"
    t = f"regexp_replace({t}, '<br\\s*/?\\s*>', chr(10), 'gi')"
    t = f"regexp_replace({t}, '</(?:p|div|li|h[1-6]|section|article)>', chr(10), 'gi')"
    t = decode_sql(f"regexp_replace({t}, '<[^>]+>', ' ', 'g')")
    t = f"regexp_replace(regexp_replace({t}, '[\\t\\f ]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g')"
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


_TITLES = f"{OPPORTUNITIES}, titles AS (SELECT id, concat('  ', title, ' – Édition № ', id % 30, 'th edition  «Ünï»  &  L''Été ', organizer) AS t FROM opportunities)"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = opportunities(spark, sf_dir, "id", "title", "organizer", heavy=True)
    return rows.select("id", F.concat(F.lit("  "), "title", F.lit(" – Édition № "), (F.col("id") % 30).cast("string"), F.lit("th edition  «Ünï»  &  L'Été "), "organizer").alias("t"))


@query(f"WITH {_TITLES} SELECT id, {clean_sql('t', 40)} AS clean, {identity_sql('t')} AS identity, {match_sql('t')} AS match, substring(regexp_replace({identity_sql('t')}, ' +', '-', 'g'), 1, 72) AS slug FROM titles")
def text_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX1 TX2 TX3 TX7 TX8 TX24: normal forms of titles."""
    c = F.col("t")
    return titles(spark, sf_dir).select("id", T.clean(c, 40).alias("clean"), T.identity_text(c).alias("identity"), T.match_text(c).alias("match"), T.slug(c).alias("slug"))


@query(f"""WITH {_TITLES}, m AS (SELECT id, {match_sql('t')} AS m, {series_sql('t')} AS k FROM titles)
SELECT id, k AS series_key, {squeeze_sql("regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '\\b(?:19|20)[0-9]{2}\\b', ' ', 'g'), '\\b[0-9]{1,3}(?:st|nd|rd|th)\\b', ' ', 'g'), '\\b(?:annual )?edition [0-9]{1,3}\\b', ' ', 'g'), '\\b(?:open call|call for (?:entries|films|projects)|applications?|submissions?)\\b', ' ', 'g')")} AS event_series FROM m""")
def text_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX4 TX5 TX6: keys that are the same for all editions."""
    return titles(spark, sf_dir).select("id", T.series_key(F.col("t")).alias("series_key"), T.event_series(F.col("t")).alias("event_series"))


@query(f"""WITH {OPPORTUNITIES}, w AS (SELECT id, list_distinct(list_filter(string_split({match_sql('title')}, ' '), lambda x: length(x) >= 3)) AS a, list_distinct(list_filter(string_split({match_sql('summary')}, ' '), lambda x: length(x) >= 3)) AS b FROM opportunities)
SELECT id, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0 END, 6) AS overlap, round(CASE WHEN len(a) + len(b) > 0 THEN 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0 END, 6) AS dice FROM w""")
def array_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX9 TX10 TX11 D12: token overlap and Dice."""
    rows = opportunities(spark, sf_dir, "id", "title", "summary").select("id", T.tokens(T.match_text(F.col("title"))).alias("a"), T.tokens(T.match_text(F.col("summary"))).alias("b"))
    return rows.select("id", F.round(T.overlap(F.col("a"), F.col("b")), 6).alias("overlap"), F.round(T.dice(F.col("a"), F.col("b")), 6).alias("dice"))


@query(f"""WITH {_TITLES} SELECT id, array_to_string(list_filter(regexp_split_to_array({fold_sql('lower(t)')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^[0-9]+$') AND NOT list_contains([{', '.join(map(_q, T.GENERIC_WORDS))}], x)), ' ') AS words,
array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace({fold_sql('lower(t)')}, '\\b(?:19|20)[0-9]{{2}}\\b', ' ', 'g'), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: substring(x, 1, 1)), '') AS initials FROM titles""")
def text_distinctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX14 TX15 TX16 TX17: distinctive words and initials."""
    return titles(spark, sf_dir).select("id", F.array_join(T.distinctive(F.col("t")), " ").alias("words"), T.initials(F.col("t")).alias("initials"))


@query(f"""WITH {OPPORTUNITIES} SELECT id, regexp_matches({squeeze_sql("regexp_replace(regexp_replace(title, '\\b(?:19|20)[0-9]{2}\\b', ' ', 'g'), '[|:–—\\-!.,()\\[\\]\"''«»]+', ' ', 'g')")}, '^(?:(?:early\\s*-?\\s*bird|earlybird|regular|late|final|extended|standard|last)?\\s*deadlines?\\b.*|open\\s+calls?)$', 'i') AS generic,
len(list_filter(string_split({match_sql('organizer')}, ' '), lambda x: NOT list_contains(string_split({match_sql('title')}, ' '), x))) > 0 AS adds FROM opportunities""")
def text_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX20 TX21: headings that are no names; organizers that add a word."""
    rows = opportunities(spark, sf_dir, "id", "title", "organizer")
    return rows.select("id", T.is_generic_title(F.col("title")).alias("generic"), T.adds_information(F.col("organizer"), F.col("title")).alias("adds"))


@query(f"""WITH p AS (SELECT page_id, {decode_sql("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")} AS t FROM pages) SELECT page_id, {squeeze_sql('t')} AS title, contains(lower({squeeze_sql('t')}), 'the') AS evidence FROM p""")
def text_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX18 TX28 HT9: decoded titles and evidence."""
    p = spread(table(spark, sf_dir, "pages")).select("page_id", H.title(F.col("html")).alias("title"))
    return p.select("page_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.lower("title").contains("the"), F.lit(False)).alias("evidence"))


_HOST = "regexp_replace(regexp_extract(url, '^(https?)://([^/?#:]+)', 2), '^www\\.', '')"


@query(f"""WITH h AS (SELECT page_id, {_HOST} AS host, url FROM pages) SELECT page_id, host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS base, regexp_matches(url, '^https?://[^/]+/?(?:[?#].*)?$') AS root, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), ''), '/') AS path FROM h""")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, base domain, root and path."""
    u = F.col("url")
    return spread(table(spark, sf_dir, "pages")).select("page_id", U.host(u).alias("host"), U.base_domain(U.host(u)).alias("base"), U.is_root(u).alias("root"), U.path(u).alias("path"))


def _query_sql(drop: str) -> str:
    return f"coalesce(nullif('?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(?:{drop})$'))), '&'), '?'), '')"


@query(f"""SELECT page_id, regexp_extract(url, '^(https?)', 1) || '://' || regexp_extract(url, '^https?://([^/?#:]+)', 1) || regexp_replace(coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), ''), '/'), '/{{2,}}', '/', 'g') || {_query_sql('utm_.*|dclid|fbclid|gclid|mc_cid|mc_eid|msclkid|ref_src|igshid')} AS canonical,
{_HOST} || CASE WHEN length(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1)) > 1 THEN regexp_replace(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), '/+$', '') ELSE '/' END || {_query_sql('utm_campaign|utm_content|utm_medium|utm_source|utm_term|dclid|fbclid|gclid|mc_cid|mc_eid|msclkid|ref_src|igshid|ref|source')} AS key FROM pages""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs and match keys."""
    return spread(table(spark, sf_dir, "pages")).select("page_id", U.canonical(F.col("url")).alias("canonical"), U.match_key(F.col("url")).alias("key"))


@query(f"""WITH {OPPORTUNITIES} SELECT id, coalesce(regexp_matches(official_url, '^https?://(?:[^/]+\\.)?filmfreeway\\.com/'), false) AS blocked, coalesce(regexp_matches(coalesce(application_url, official_url), '^https?://(?:[^/]+\\.)?(?:filmfreeway|festhome)\\.com/'), false) AS platform,
list_contains([regexp_replace(source_url, '/+$', ''), 'https://x.example.org'], regexp_replace(coalesce(official_url, ''), '/+$', '')) AS grounded, source_url || '?page=' || (id % 7)::VARCHAR AS next FROM opportunities""")
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platforms, grounding and next requests."""
    rows = opportunities(spark, sf_dir, "id", "official_url", "application_url", "source_url")
    seen = F.array("source_url", F.lit("https://x.example.org/"))
    return rows.select("id", U.host_in(U.host(F.col("official_url")), U.BLOCKED_HOSTS).alias("blocked"), U.is_platform(U.host(F.coalesce("application_url", "official_url"))).alias("platform"), U.grounded(F.col("official_url"), seen).alias("grounded"), U.next_request(U.safe(F.col("source_url")), "page", F.col("id") % 7).alias("next"))


@query(f"SELECT page_id, {plain_sql('html')} AS text FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT1: the text of each page."""
    return spread(table(spark, sf_dir, "pages")).select("page_id", H.plain_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, sha256({plain_sql('html')}) AS digest FROM pages")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT10: a hash of the text of each page."""
    return spread(table(spark, sf_dir, "pages")).select("page_id", F.sha2(H.plain_text(F.col("html")), 256).alias("digest"))


@query(f"""WITH a AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '(<a\\b[^>]*>.*?</a>)', 1, 'is')) AS a, generate_subscripts(regexp_extract_all(html, '(<a\\b[^>]*>.*?</a>)', 1, 'is'), 1) - 1 AS position FROM pages),
h AS (SELECT page_id, position, regexp_extract(base, '^(https?://[^/?#]+)', 1) || regexp_extract(a, '^<a\\b[^>]*?\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is') AS url, substring({squeeze_sql(decode_sql("regexp_replace(a, '<[^>]+>', ' ', 'g')"))}, 1, 240) AS text FROM a)
SELECT page_id, min(position)::INT AS position, url, arg_min(text, position) AS text FROM h GROUP BY page_id, url""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT2 D13: the links of each page, each once."""
    return H.links(spread(table(spark, sf_dir, "pages")), "page_id", "url", "html").select("page_id", "position", "url", "text")


@query(f"""SELECT page_id, nullif({squeeze_sql(decode_sql("regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 'is')"))}, '') AS heading, length({plain_sql('html')}) < 600 AND len(regexp_extract_all(html, '(<a\\b[^>]*>.*?</a>)', 1, 'is')) < 6 AS shell, CASE WHEN length({plain_sql('html')}) < 80 THEN 'EMPTY_PAGE' END AS gate FROM pages""")
def page_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC9 SC12 HT9: headings, script shells and gates of pages."""
    p = spread(table(spark, sf_dir, "pages")).withColumn("t", H.plain_text(F.col("html")))
    return p.select("page_id", H.heading(F.col("html")).alias("heading"), H.looks_like_shell(F.col("t"), F.size(H.anchors(F.col("html")))).alias("shell"), H.gate(F.lit(200), F.lit("text/html"), F.col("t")).alias("gate"))


@query("""SELECT page_id, NOT (regexp_matches(path, '^/en/') AND NOT regexp_matches(path, '^/en/[0-9]*5')) AND NOT regexp_matches(path, '\\.html$') AS allowed FROM (SELECT page_id, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), ''), '/') AS path FROM pages)""")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC13 U21: robots rules, the longest match decides."""
    rules = F.array(*[F.struct(F.lit(a).alias("allow"), F.lit(p).alias("pattern")) for a, p in ((False, "/en/"), (True, "/en/*5"), (False, "/*.html$"))])
    return spread(table(spark, sf_dir, "pages")).select("page_id", H.robots_allowed(U.path(F.col("url")), rules).alias("allowed"))


_DATED = f"{OPPORTUNITIES}, dated AS (SELECT id, concat('Deadline ', strftime(discovered_at, '%Y-%m-%d'), ', results on 31/02/1999 or ', day(discovered_at), ' octubre de 2001; opens March 7, 2001.') AS t FROM opportunities)"


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = opportunities(spark, sf_dir, "id", "discovered_at", heavy=True)
    d = F.col("discovered_at")
    return rows.select("id", F.concat(F.lit("Deadline "), F.date_format(d, "yyyy-MM-dd"), F.lit(", results on 31/02/1999 or "), F.day(d).cast("string"), F.lit(" octubre de 2001; opens March 7, 2001.")).alias("t"))


@query(f"""WITH {_DATED}, m AS (SELECT id, list_sort(list_distinct(list_filter([CASE WHEN regexp_extract(t, '(20[0-9]{{2}})-[0-9]{{2}}-[0-9]{{2}}') <> '' THEN try_cast(regexp_extract(t, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}') AS DATE) END,
make_date(2001, 10, regexp_extract(t, 'or ([0-9]+) octubre', 1)::INT), DATE '2001-03-07'], lambda x: x IS NOT NULL))) AS d FROM dated)
SELECT id, array_to_string(d, ',') AS dates, len(list_filter(d, lambda x: x >= DATE '2001-03-01' AND x <= DATE '2001-03-04' + 548))::INT AS upcoming FROM m""")
def date_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT3 DT4 DT5: dates mentioned in texts, and those ahead."""
    now = moment("2001-03-04 12:00:00")
    return dated(spark, sf_dir).select("id", F.array_join(D.mentions(F.col("t")).cast("array<string>"), ",").alias("dates"), F.size(D.upcoming(F.col("t"), now)).alias("upcoming"))


@query(f"""WITH {OPPORTUNITIES} SELECT id, CASE WHEN deadline IS NULL THEN 'none' WHEN days < 0 THEN 'passed' WHEN days <= 7 THEN 'urgent' WHEN days <= 14 THEN 'soon' ELSE 'later' END AS tone, days::INT AS days,
CASE id % 3 WHEN 0 THEN strftime(discovered_at, '%Y-%m-%d 23:59:59') WHEN 1 THEN strftime(discovered_at, '%Y-%m-%d 10:20:00') ELSE strftime(discovered_at, '%Y-%m-%d 23:59:59') END AS normal,
(date_trunc('day', discovered_at) + INTERVAL 1 DAY * ((8 - isodow(discovered_at)) % 7)::INT)::DATE::VARCHAR AS monday
FROM (SELECT *, ceil((epoch_us(deadline) - epoch_us(TIMESTAMP '{NOW}')) / 86400000000.0::DOUBLE) AS days FROM opportunities) WHERE year(discovered_at) >= 2000""")
def deadline_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT1 DT12 DT13 DT14: normalised deadlines, countdowns and Mondays."""
    d, k = F.col("discovered_at"), F.col("id")
    rows = opportunities(spark, sf_dir, "id", "discovered_at", "deadline").where(F.year(d) >= 2000)
    raw = F.when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 3 == 1, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:20:00Z"))).otherwise(F.concat(F.day(d).cast("string"), F.lit(" "), F.date_format(d, "MMMM yyyy")))
    count = D.countdown(F.col("deadline"), moment(NOW))
    return rows.select("id", count["tone"].alias("tone"), count["days"].alias("days"), D.normalize_deadline(raw, moment("2000-06-15 00:00:00")).cast("string").alias("normal"), D.monday_of_brief(F.to_date(d)).cast("string").alias("monday"))


@query(f"""WITH {_TITLES} SELECT id, regexp_extract(t, '((?:19|20)[0-9]{{2}})', 1)::INT AS year, (id % 30)::VARCHAR || 'th' AS edition FROM titles""")
def inferred_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT9 DT10: years and editions in titles."""
    return titles(spark, sf_dir).select("id", D.year_of(F.col("t")).alias("year"), D.edition_of(F.col("t")).alias("edition"))


@query("""SELECT c_custkey, strftime(TIMESTAMP '1998-06-15 10:20:00' + INTERVAL 1 MILLISECOND * floor(('0x' || substring(sha256('stagger' || chr(31) || c_name), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 14 * 86400000)::BIGINT, '%Y-%m-%d %H:%M:%S') AS first_check FROM customer""")
def staggered_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT15: first checks spread over two weeks by hash."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.date_format(D.staggered(F.col("c_name"), moment(NOW), 14, "stagger"), "yyyy-MM-dd HH:mm:ss").alias("first_check"))


_PAT = "regexp_matches(concat_ws(' ', url, text), '{}', 'i')::INT"


@query(f"""WITH a AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '(<a\\b[^>]*>.*?</a>)', 1, 'is')) AS a FROM pages), l AS (SELECT DISTINCT page_id, regexp_extract(base, '^https?://([^/?#]+)', 1) AS page_host, regexp_extract(base, '^(https?://[^/?#]+)', 1) || regexp_extract(a, 'href="([^"]+)"', 1) AS url, '' AS text FROM a),
s AS (SELECT page_id, url, {' + '.join(_PAT.format(p[4:].replace("'", "''")) for p in H.LINK_POSITIVE)} + 1 AS score FROM l) SELECT page_id, count(*) AS links, max(score)::INT AS best FROM s GROUP BY page_id""")
def link_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT3 W9: scores of the links of each page (the bare URLs of these pages)."""
    pages = spread(table(spark, sf_dir, "pages"))
    links = H.links(pages, "page_id", "url", "html").select("page_id", "url", F.lit("").alias("text")).join(pages.select("page_id", U.raw_host(F.col("url")).alias("page_host")), "page_id")
    return ranking.link_scores(links, H.LINK_POSITIVE, [], ["."], 2999).groupBy("page_id").agg(F.count("*").alias("links"), F.max("score").alias("best"))
