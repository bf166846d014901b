"""Jobs: compositions of the operators, each one DAG, with rejects as a side output where a stage drops rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import extract as X
from ..functions import html as H
from ..functions import pages as grants
from ..functions import review, rules
from ..functions import text as T
from ..functions import url as U
from ..operators import dedupe, joins, metrics, ranking, state
from ..sources import readers, sinks
from .base import NOW, OPPORTUNITIES, SOURCES, moment, opportunities, query, sources, spread, table
from .ranking import _DUE, _ORDER


@query(f"""WITH {SOURCES}, d AS (SELECT * FROM sources WHERE {_DUE} AND NOT (url LIKE 'https://site3.example.org/%')), r AS (SELECT *, row_number() OVER (ORDER BY priority, {_ORDER}) - 1 AS position FROM d WHERE priority < 3 QUALIFY position < 12),
x AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 + (SELECT count(*) FROM r) AS position FROM d WHERE id NOT IN (SELECT id FROM r)), p AS (SELECT id, url, position FROM r UNION ALL SELECT id, url, position FROM x WHERE position < 40)
SELECT id, position::INT AS position, url || '?page=' || coalesce(s_suppkey % 4, 1)::VARCHAR AS request FROM p LEFT JOIN supplier ON s_suppkey = id""")
def job_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JB1: throttle, due selection, checkpoints and request URLs."""
    rows = sources(spark, sf_dir)
    chosen = ranking.select_due(rows.where(~U.host_in(U.host(F.col("url")), ["site3.example.org"])), moment(NOW), 40)
    page = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4).alias("page"))
    plan = joins.lookup(chosen.select("id", "position", "url"), page, "id", {"page": 1})
    return plan.select("id", "position", U.next_request(F.col("url"), "page", F.col("page")).alias("request"))


def _discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through gate, call signal, category and keys; ``code`` is why a page is dropped."""
    pages = spread(table(spark, sf_dir, "pages")).select("page_id", U.canonical(F.col("url")).alias("url"), "html")
    read = pages.select("page_id", "url", H.plain_text(F.col("html")).alias("text"), H.title(F.col("html")).alias("title"))
    signal = X.call_signal(F.col("text"), moment(NOW), lenient=True)
    category = X.category_for(F.lit(None).cast("string"), F.col("title"), F.lit(""))
    read = read.withColumns({"signal": signal, "category": category})
    code = F.when(F.col("url").isNull(), "INVALID_URL").when(F.length("text") < 80, "EMPTY_PAGE").when(~F.col("signal.pass"), "NO_CALL_SIGNAL").when(T.is_generic_title(F.col("title")), "GENERIC_TITLE").when(F.col("category").isNull(), "UNSUPPORTED_CATEGORY")
    return read.withColumn("code", code)


@query()
def job_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JB2 X11 X28: pages by what became of them (tested on fixtures)."""
    return _discover(spark, sf_dir).groupBy(F.coalesce("code", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("pages"))


@query()
def job_auto_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JB6 M-3 X24 R4: decisions over pending records, duplicates first (tested case by case)."""
    rows = opportunities(spark, sf_dir)
    keep = ranking.keepers(rows, "canonical_key").select("canonical_key", F.col("id").alias("keeper"))
    rows = rows.where("review_decision = 'pending'").join(keep, "canonical_key")
    k = F.col("id")
    page = F.struct(
        (k % 7 != 3).alias("ok"), F.lit(200).alias("http_status"), F.col("official_url").alias("final_url"), (k % 11 == 5).alias("closed"), (k % 5 != 1).alias("call_signal"), (k % 4 != 3).alias("date_found"), F.lit(False).alias("open_found"), F.lit(True).alias("film"),
        F.lit(False).alias("all_disciplines"), F.lit(False).alias("other_only"), (k % 29 == 3).alias("directory"), (k % 6 != 1).alias("year_found"), F.lit(None).cast("string").alias("organizer"))
    d = review.auto_review(moment(NOW), page, k != F.col("keeper"), F.lit(False))
    return rows.withColumn("d", d).select("id", "d.decision", "d.target", F.array_join("d.reasons", ",").alias("reasons"))


@query(f"""WITH {OPPORTUNITIES}, p AS (SELECT id, source_url FROM opportunities WHERE entry_fee_amount IS NULL), u AS (SELECT source_url FROM opportunities GROUP BY 1 HAVING count(*) = 1) SELECT id, source_url AS page FROM p JOIN u USING (source_url)""")
def job_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JB5 A23: records with missing facts whose page is theirs alone."""
    rows = opportunities(spark, sf_dir, "id", "source_url", "entry_fee_amount")
    own = metrics.shared_pages(rows.select("id", "source_url"), F.col("source_url"), "id")
    return rows.where("entry_fee_amount is null").select("id").join(own, "id")


@query(f"""WITH {SOURCES}, r AS (SELECT concat('site', (id % 97)::VARCHAR, '.example.org') AS host, id, name, url, country FROM sources WHERE country IS NOT NULL), held AS (SELECT DISTINCT host FROM r WHERE id % 10 = 0),
n AS (SELECT host, count(*) AS n FROM r WHERE host NOT IN (SELECT host FROM held) GROUP BY host), k AS (SELECT DISTINCT concat('site', (s_suppkey % 97)::VARCHAR, '.example.org') AS host FROM supplier WHERE s_suppkey % 4 = 0)
SELECT host, n AS rows FROM n WHERE host NOT IN (SELECT host FROM k)""")
def job_import_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JB15 J8 J10 SK2: seeds per site, without held-out and known ones."""
    rows = sources(spark, sf_dir).where("country is not null").select(U.host(F.col("url")).alias("host"), "id")
    held = rows.where("id % 10 = 0").select("host")
    per = rows.join(held, "host", "left_anti").groupBy("host").agg(F.count("*").alias("rows"))
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select(F.concat(F.lit("site"), (F.col("s_suppkey") % 97).cast("string"), F.lit(".example.org")).alias("host"))
    return per.join(known, "host", "left_anti")


@query("""WITH f AS (SELECT l_orderkey AS series, l_suppkey AS site, l_linenumber % 3 AS rank FROM lineitem), b AS (SELECT series, min(rank * 1000000 + site) AS best FROM f WHERE series NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY series)
SELECT series, (best % 1000000)::BIGINT AS site, best // 1000000 AS rank FROM b ORDER BY rank, series LIMIT 100""")
def job_resolve_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JB17 JB16: the best site of each series that is not registered; a top-k report."""
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_suppkey").alias("site"), (F.col("l_linenumber") % 3).alias("rank"))
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("series"))
    best = f.join(known, "series", "left_anti").groupBy("series").agg(F.min(F.struct("rank", "site")).alias("b"))
    return best.select("series", "b.site", F.col("b.rank").cast("bigint").alias("rank")).orderBy("rank", "series").limit(100)


@query("""WITH c AS (SELECT o_orderkey AS card_id, sha256(o_orderstatus || o_totalprice::BIGINT::VARCHAR) AS card_hash FROM orders), s AS (SELECT o_orderkey AS card_id, sha256('F' || o_totalprice::BIGINT::VARCHAR) AS known FROM orders WHERE o_orderkey % 2 = 0)
SELECT c.card_id FROM c LEFT JOIN s USING (card_id) WHERE known IS DISTINCT FROM card_hash""")
def job_harvest_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JB19 SC21 ST12: listing cards that are new or changed."""
    o, price = table(spark, sf_dir, "orders"), F.round("o_totalprice").cast("bigint").cast("string")
    cards = o.select(F.col("o_orderkey").alias("card_id"), F.sha2(F.concat("o_orderstatus", price), 256).alias("card_hash"))
    known = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("card_id"), F.sha2(F.concat(F.lit("F"), price), 256).alias("card_hash"))
    return readers.changed_cards(cards, known).select("card_id")


@query("""SELECT c_custkey AS url FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-15 10:20:00' - INTERVAL 30 DAY)""")
def job_harvest_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JB20 JB21 SC23: pages not read for thirty days."""
    urls = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"))
    return readers.due_pages(urls, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderdate").alias("read_at")), moment(NOW), 30)


def _ingested(records: DataFrame, known: DataFrame) -> DataFrame:
    """(title, closing, records, action) of records (seq, title, closing): folded and merged, and whether each is new or updates a known title."""
    name = T.identity_text(F.col("title"))
    keyed = records.select(F.col("seq").cast("bigint").alias("seq"), name.alias("canonical"), F.concat_ws("|", name, F.coalesce("closing", F.lit("open"))).alias("fuzzy"), F.lit(0.5).alias("confidence"), "title", "closing")
    merged = dedupe.merge_groups(dedupe.fold_duplicates(keyed), ["title", "closing"], {})
    both = merged.join(known.select("title", F.lit(True).alias("known")).distinct(), "title", "left")
    return both.select("title", "closing", "records", F.when(F.col("known"), "update").otherwise("insert").alias("action"))


_INGEST = "SELECT title, arg_min(closing, seq) FILTER (closing IS NOT NULL) AS closing, count(*) AS records, CASE WHEN title IN (SELECT title FROM known) THEN 'update' ELSE 'insert' END AS action FROM r GROUP BY title"


@query(f"""WITH r AS (SELECT page_id AS seq, 'Bando corti ' || (page_id % 20)::VARCHAR AS title, CASE WHEN page_id % 4 <> 1 THEN '2026-05-0' || (1 + page_id % 9)::VARCHAR END AS closing FROM pages WHERE page_id % 3 <> 0), known AS (SELECT 'Bando corti ' || s_suppkey::VARCHAR AS title FROM supplier WHERE s_suppkey % 2 = 0) {_INGEST}""")
def job_harvest_italy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JB21 SC23 HT17 X26 D1 SK5: grant pages that are due, read, folded and ingested."""
    k = F.col("page_id")
    now = moment("2026-03-01 09:00:00")
    day = F.concat(F.lit("0"), (1 + k % 9).cast("string"), F.lit(".05.2026"))
    text = F.concat(F.lit("Scheda bando Aperto "), F.when(k % 4 != 1, F.concat(F.lit("Scadenza sessioni: "), day)).otherwise(""))
    pages = table(spark, sf_dir, "pages").select(k.alias("url"), text.alias("text"), F.concat(F.lit("<h1>Bando corti "), (k % 20).cast("string"), F.lit("</h1>")).alias("html"))
    read = pages.select("url", F.when(F.col("url") % 3 == 0, moment("2026-02-20 00:00:00")).otherwise(moment("2026-01-01 00:00:00")).alias("read_at"))
    due = readers.due_pages(pages, read, now, 30)
    g = grants.grant_facts(F.col("text"), F.col("html"), F.array().cast("array<struct<url:string,text:string>>"))
    facts = due.select(F.col("url").alias("seq"), g.alias("g")).select("seq", "g.title", F.col("g.closing").cast("string").alias("closing"))
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("Bando corti "), F.col("s_suppkey").cast("string")).alias("title"))
    return _ingested(facts, known)


@query(f"""WITH r AS (SELECT o_orderkey AS seq, 'Film fund ' || (o_orderkey % 50)::VARCHAR AS title, '2026-0' || (6 + o_orderkey % 3)::VARCHAR || '-01' AS closing FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0), known AS (SELECT 'Film fund ' || s_suppkey::VARCHAR AS title FROM supplier) {_INGEST}""")
def job_harvest_portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JB20 SC22 HT15 X26 D1 SK5: a portal's topics in scope and still open, with their next cut-off, folded and ingested."""
    k = F.col("o_orderkey")
    title = F.concat(F.when(k % 3 == 0, "Film fund ").otherwise("Road fund "), (k % 50).cast("string"))
    status = F.when(k % 5 == 0, "closed").otherwise("open")
    answer = F.format_string('{"results": [{"metadata": {"identifier": "T-%d", "title": "%s", "deadlines": ["2026-05-01", "2026-0%d-01"], "actions": ["{\\"status\\": \\"%s\\"}"]}}]}', k, title, 6 + k % 3, status)
    topics = table(spark, sf_dir, "orders").select(k.alias("seq"), F.explode(rules.topics(answer)).alias("t")).where((F.col("t.status") == "open") & F.lower("t.title").contains("film"))
    days = F.transform("t.deadlines", lambda d: d.cast("date"))
    facts = topics.select("seq", "t.title", D.next_cutoff(days, F.lit("2026-05-15").cast("date")).cast("string").alias("closing"))
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Film fund "), F.col("s_suppkey").cast("string")).alias("title"))
    return _ingested(facts, known)


@query(f"""WITH c AS (SELECT o_orderkey AS seq, 'Aurora ' || (o_orderkey % 70)::VARCHAR || ' Fest' AS title FROM orders), r AS (SELECT seq, title, NULL::VARCHAR AS closing FROM c WHERE seq % 4 <> 0), known AS (SELECT 'Aurora ' || s_suppkey::VARCHAR || ' Fest' AS title FROM supplier) {_INGEST}""")
def job_harvest_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JB19 SC21 ST12 HT13 HT14 X26 D1 SK5: a platform's cards that are new or changed, folded and ingested."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("Aurora "), (k % 70).cast("string"), F.lit(" Fest"))
    html = F.concat(F.lit('<p><a href="/festival/'), k.cast("string"), F.lit('"><b>'), name, F.lit("</b></a></p>"))
    cards = table(spark, sf_dir, "orders").select(F.explode(rules.listing_cards(html)).alias("c")).select(F.col("c.id").alias("card_id"), F.col("c.text").alias("title"), F.sha2(F.col("c.text"), 256).alias("card_hash"))
    known_cards = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(k.alias("card_id"), F.when(k % 4 == 0, F.sha2(name, 256)).otherwise("old").alias("card_hash"))
    facts = readers.changed_cards(cards, known_cards).select(F.col("card_id").alias("seq"), "title", F.lit(None).cast("string").alias("closing"))
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Aurora "), F.col("s_suppkey").cast("string"), F.lit(" Fest")).alias("title"))
    return _ingested(facts, known)


@query("""SELECT l_suppkey AS item, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS sites, min(l_linestatus) AS country FROM lineitem GROUP BY l_suppkey HAVING NOT bool_or(l_quantity > 49.5 AND l_suppkey % 2 = 0) AND count(CASE WHEN l_suppkey % 5 = 0 THEN 1 END) = 0""")
def wikidata_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC17: bindings of items, without dissolved ones and those with a series."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_returnflag").alias("site"), F.col("l_linestatus").alias("country"), ((F.col("l_quantity") > 49.5) & (F.col("l_suppkey") % 2 == 0)).alias("dissolved"), F.when(F.col("l_suppkey") % 5 == 0, F.lit("s")).alias("series"))
    return readers.bindings(rows).withColumn("sites", F.array_join("sites", ","))


@query(f"WITH {OPPORTUNITIES} SELECT '<url><loc>https://example.org/' || slug || '</loc><lastmod>' || strftime(discovered_at, '%Y-%m-%d') || '</lastmod></url>' AS entry FROM opportunities WHERE status = 'open'")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK13: entries of a sitemap."""
    rows = opportunities(spark, sf_dir, "slug", "status", "discovered_at").where("status = 'open'")
    return sinks.sitemap(rows.withColumnRenamed("discovered_at", "lastmod"), "https://example.org")


@query("SELECT c_custkey AS id, coalesce(c_name, '') AS title, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, 'unclear') AS ai_policy, 0 AS confidence FROM customer")
def rectangular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK6 JM14: every column, with defaults for what is missing."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("ai_policy"))
    return readers.rectangular(rows, {"id": None, "title": "", "ai_policy": "unclear", "confidence": 0})


@query("""SELECT o_orderkey AS url, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F','O') AND o_orderdate < TIMESTAMP '1998-01-01' THEN NULL ELSE o_orderpriority END AS processed_hash FROM orders""")
def requeue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK15 JB23: settled pages that are to be read again."""
    cache = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_orderpriority").alias("source_id"), F.col("o_orderstatus").alias("processor"), F.col("o_orderdate").alias("processed_at"), F.col("o_orderpriority").alias("processed_hash"))
    fam = cache.select("source_id", F.when(F.col("source_id") == "1-URGENT", "series").otherwise("x").alias("source_family")).distinct()
    return sinks.requeue(cache, fam, "series", ["F", "O"], moment("1998-01-01 00:00:00")).select("url", "processed_hash")


@query("SELECT c_custkey AS url, CASE WHEN c_custkey % 2 = 0 THEN 'seed' ELSE c_name END AS name, c_custkey NOT IN (4, 7) AS enabled FROM customer")
def seed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK16 JB24: the catalogue replaces its rows; retired URLs are disabled."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"), F.col("c_name").alias("name"), F.lit(True).alias("enabled"))
    return sinks.seed(old, old.where("url % 2 = 0").withColumn("name", F.lit("seed")), "url", [4, 7])


@query(f"WITH {OPPORTUNITIES} SELECT id, review_decision, confidence FROM opportunities WHERE id % 3 = 0")
def upsert_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST14 SK1: inserting what is there already changes nothing."""
    rows = opportunities(spark, sf_dir, "id", "review_decision", "confidence").where("id % 3 = 0")
    return state.replace_rows(rows, rows, "id")

