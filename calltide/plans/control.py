"""Queries on what surrounds the pipeline: fetching, search, models, schedules, ingest, logs, reports, imports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue as cat
from ..operators import control, dedupe
from ..operators import matching as match
from ..operators.graph import shared_folder
from ..sources import readers, sinks
from . import cases
from .base import OPPORTUNITIES, moment, opportunities, query, table


def _expected(names: str, rows: list[tuple[tuple, tuple]], typed: str) -> str:
    return f"WITH {cases.values(names, [want for _, want in rows])} SELECT c_custkey AS id, {typed} FROM customer JOIN cases ON c_custkey % {len(rows)} = k"


def _dealt(spark: SparkSession, sf_dir: str, rows: list[tuple[tuple, tuple]], schema: str) -> DataFrame:
    return cases.dealt(spark, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), [given for given, _ in rows], schema)


@query("""SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 1 END::INT AS attempts, c_custkey % 6 IN (0, 2, 4) AS ok, c_custkey % 6 = 4 AS tls_fallback, CASE c_custkey % 6 WHEN 1 THEN 'HTTP_ERROR' WHEN 3 THEN 'FETCH_TIMEOUT' WHEN 5 THEN 'FETCH_FAILED' END AS reason FROM customer""")
def settled_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC11: attempts that are retried, given up, or answered over http."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")

    def attempt(n: int, scheme: str, ok: object, status: object, reason: object, error: object) -> object:
        return F.struct(F.lit(n).alias("attempt"), F.lit(f"{scheme}://x.org/").alias("url"), F.lit(ok).alias("ok"), F.lit(status).cast("int").alias("http_status"), (F.lit(reason) if reason else none).alias("reason"), (F.lit(error) if error else none).alias("error"))

    tries = (
        F.when(k % 6 == 0, F.array(attempt(1, "https", True, 200, None, None))).when(k % 6 == 1, F.array(attempt(1, "https", False, 404, "HTTP_ERROR", None)))
        .when(k % 6 == 2, F.array(attempt(1, "https", False, 503, "HTTP_ERROR", None), attempt(2, "https", True, 200, None, None)))
        .when(k % 6 == 3, F.array(attempt(1, "https", False, None, "FETCH_TIMEOUT", None), attempt(2, "https", False, None, "FETCH_TIMEOUT", None), attempt(3, "https", True, 200, None, None)))
        .when(k % 6 == 4, F.array(attempt(1, "https", False, None, "FETCH_FAILED", "CERT_HAS_EXPIRED"), attempt(2, "http", True, 200, None, None)))
        .otherwise(F.array(attempt(1, "https", False, None, "FETCH_FAILED", "self_signed certificate"), attempt(2, "http", False, 500, "HTTP_ERROR", None)))
    )
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.explode(tries).alias("t")).select("id", "t.*")
    return control.settle_attempts(rows, "id").select("id", "attempts", "ok", "tls_fallback", "reason")


@query("""WITH h AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, 'https://site' || (l_partkey % 50)::VARCHAR || '.org/a' AS url, l_quantity AS score FROM lineitem), q AS (SELECT query_id, row_number() OVER (ORDER BY query_id) AS n FROM (SELECT DISTINCT query_id FROM h))
SELECT query_id, url, min(rank)::INT AS rank, arg_min(score, rank * 1000 + score) AS score FROM h JOIN q USING (query_id) WHERE n <= 300 GROUP BY 1, 2""")
def paid_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC14 SC15: results of the searches that the month's credits pay, in their order."""
    li = table(spark, sf_dir, "lineitem")
    url = F.concat(F.lit("https://site"), (F.col("l_partkey") % 50).cast("string"), F.lit(".org/a?utm_source=q#x"))
    hits = li.select(F.col("l_orderkey").alias("query_id"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("rank"), url.alias("url"), F.lit("t").alias("title"), F.col("l_quantity").alias("score"))
    return control.search_results(hits, credits=400, cap=1001, per_search=2).select("query_id", "url", "rank", "score")


@query("SELECT 'model ' || s_suppkey::VARCHAR AS model, CASE WHEN s_suppkey % 4 = 1 THEN 0 ELSE (s_suppkey % 7) * 60000 END::BIGINT AS wait_ms FROM supplier WHERE s_suppkey % 4 <> 0 ORDER BY 2, s_suppkey LIMIT 1")
def model_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-17: the model to ask next, and how long to wait for it."""
    k = F.col("s_suppkey")
    now = moment("2026-03-01 09:00:00")
    until = F.when(k % 4 == 1, moment("2026-03-01 08:00:00")).otherwise(now + F.make_dt_interval(F.lit(0), F.lit(0), (k % 7).cast("int")))
    models = table(spark, sf_dir, "supplier").select(k.alias("place"), F.concat(F.lit("model "), k.cast("string")).alias("model"), until.alias("cooldown_until"), (k % 4 == 0).alias("exhausted"))
    return control.next_model(models, now)


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 24000 ELSE least(24000, greatest(0, (floor(s_suppkey * 100 * 0.9::DOUBLE) - 1024 - 300) * 4)) END::BIGINT AS characters FROM supplier")
def text_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-17: characters of a page that fit a model's limit."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), control.text_budget(F.when(k % 5 != 0, k * 100), F.lit(300), 1024, 24_000).cast("bigint").alias("characters"))


@query(_expected("secret", cases.SECRETS, "secret"))
def clean_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX29: secrets without what was pasted around them."""
    return _dealt(spark, sf_dir, cases.SECRETS, "raw string").select("id", control.clean_secret(F.col("raw")).alias("secret"))


@query("""SELECT event_id, (CASE WHEN ts < date_trunc('day', ts) + INTERVAL '4 hours 43 minutes' THEN date_trunc('day', ts) + INTERVAL '4 hours 43 minutes' WHEN ts < date_trunc('day', ts) + INTERVAL '16 hours 43 minutes' THEN date_trunc('day', ts) + INTERVAL '16 hours 43 minutes' ELSE date_trunc('day', ts) + INTERVAL '28 hours 43 minutes' END)::VARCHAR AS monitor,
(CASE WHEN ts < date_trunc('day', ts) + INTERVAL '6 hours 17 minutes' THEN date_trunc('day', ts) + INTERVAL '6 hours 17 minutes' WHEN ts < date_trunc('day', ts) + INTERVAL '18 hours 17 minutes' THEN date_trunc('day', ts) + INTERVAL '18 hours 17 minutes' ELSE date_trunc('day', ts) + INTERVAL '30 hours 17 minutes' END)::VARCHAR AS discovery FROM events""")
def job_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST21: the next start of each job of the schedule."""
    start = lambda job: F.date_format(control.next_start(job, F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias(job)
    return table(spark, sf_dir, "events").select("event_id", start("monitor"), start("discovery"))


@query("SELECT event_id FROM (SELECT event_id, sum(1 + event_id % 7) OVER (ORDER BY event_id) - (1 + event_id % 7) AS spent FROM events) WHERE spent < 3000")
def timed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST20: work that starts before its time is used up."""
    work = table(spark, sf_dir, "events").select("event_id", (1 + F.col("event_id") % 7).alias("seconds"))
    return control.within_time(work, ["event_id"], "seconds", 3000).select("event_id")


@query(_expected("status, accepted", cases.INGESTS, "status::INT AS status, accepted::INT AS accepted"))
def ingest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK9: bounded ingest requests and their answers."""
    rows = _dealt(spark, sf_dir, cases.INGESTS, "authorized boolean, body string")
    return rows.select("id", control.ingest_answer(F.col("authorized"), F.col("body")).alias("a")).select("id", "a.status", F.col("a.accepted").cast("int").alias("accepted"))


@query("SELECT e.event_id, CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS value FROM events e WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def append_only_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST17: a log takes inserts of new rows, and no other change."""
    e = table(spark, sf_dir, "events").select("event_id")
    log = e.where("event_id % 2 = 0").withColumn("value", F.lit("old"))
    k = F.col("event_id")
    changes = e.select("event_id", F.lit("new").alias("value"), F.when(k % 3 == 0, "insert").when(k % 3 == 1, "update").otherwise("delete").alias("action"))
    return control.append_only(log, changes, "event_id")[0]


@query("SELECT event_id, event_id % 5 = 0 OR event_id % 2 = 1 AS touched FROM events")
def touched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST18: rows that a write has changed or added take its time."""
    e = table(spark, sf_dir, "events").select("event_id", "value", F.when(F.col("event_id") % 3 != 0, "a").alias("note"), F.lit("old").alias("updated_at"))
    before = e.where("event_id % 2 = 0")
    after = e.withColumn("value", F.when(F.col("event_id") % 5 == 0, F.lit(-1.0)).otherwise(F.col("value")))
    return control.touched(before, after, "event_id", F.lit("new")).select("event_id", (F.col("updated_at") == "new").alias("touched"))


@query(f"""WITH {OPPORTUNITIES} SELECT 'total' AS section, 'rows' AS label, count(*) AS n FROM opportunities UNION ALL SELECT 'total', 'public', (SELECT count(*) FROM opportunities WHERE review_decision = 'approved') UNION ALL SELECT 'gap', 'no deadline', count_if(deadline IS NULL)::BIGINT FROM opportunities
UNION ALL SELECT 'gap', 'no official page', count_if(official_url IS NULL)::BIGINT FROM opportunities UNION ALL SELECT 'gap', 'no application page', count_if(application_url IS NULL)::BIGINT FROM opportunities UNION ALL SELECT 'gap', 'conflict', count_if(has_conflict)::BIGINT FROM opportunities
UNION ALL SELECT 'category', category, count(*) FROM opportunities GROUP BY category UNION ALL SELECT 'status', status, count(*) FROM opportunities GROUP BY status UNION ALL SELECT 'duplicates', 'canonical_key', (SELECT count(*) FROM (SELECT 1 FROM opportunities GROUP BY canonical_key HAVING count(*) > 1))""")
def job_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JB9: the report of an audit."""
    rows = opportunities(spark, sf_dir, "category", "status", "deadline", "official_url", "application_url", "has_conflict", "canonical_key", "review_decision")
    return control.audit_report(rows, rows.where("review_decision = 'approved'").count())


@query("""WITH l AS (SELECT o_orderstatus, o_totalprice / 100000 AS p, o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate <= TIMESTAMP '1998-06-15 10:20:00'), s AS (SELECT count(*) AS events, coalesce(sum(CASE k % 4 WHEN 0 THEN p WHEN 1 THEN CASE WHEN k % 3 = 0 THEN p ELSE p / 2 END WHEN 2 THEN p / 2 ELSE 0 END), 0) AS spent FROM l),
g AS (SELECT sum(p_size) AS queries, sum(p_size % 7) AS validated, sum(p_size % 3) AS opportunities, sum(p_size % 2) AS sources, sum(p_retailprice) AS cost FROM part WHERE p_partkey % 2 = 0)
SELECT events, round(spent, 4) AS spent, round(spent / 9, 4) AS utilization, round(spent / ((14 * 86400 + 37200) / 86400.0::DOUBLE) * 30, 2) AS run_rate, round(least(spent / ((14 * 86400 + 37200) / 86400.0::DOUBLE) * 30, 9), 2) AS enforced, queries::BIGINT AS queries, round(100 * opportunities / queries, 2) AS opportunities_per_100, round(100 * sources / queries, 2) AS sources_per_100, round(cost / validated, 4) AS cost_per_validated, round(cost / sources, 4) AS cost_per_source FROM s, g""")
def job_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JB10: the month's cost, its run rate, and what gap searches yield."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice") / 100000
    status = F.when(k % 4 == 0, "reserved").when(k % 4 == 1, "succeeded").when(k % 4 == 2, "uncertain").otherwise("blocked")
    estimated = F.when((k % 4 == 1) & (k % 3 == 0), F.lit(None).cast("double")).otherwise(p / 2)
    ledger = table(spark, sf_dir, "orders").select(F.lit("p").alias("provider"), F.lit("o").alias("operation"), status.alias("status"), F.col("o_orderdate").alias("at"), p.alias("reserved"), estimated.alias("estimated"))
    size = F.col("p_size")
    attempts = table(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 2 == 0, "gap-search").otherwise("monitor").alias("kind"), size.alias("queries"), size.alias("candidates"), (size % 7).alias("validated"), (size % 3).alias("opportunities"), (size % 2).alias("sources"), F.col("p_retailprice").alias("cost"))
    out = control.cost_report(ledger, attempts, moment("1998-06-01 00:00:00"), moment("1998-06-15 10:20:00"), 9.0)
    return out.withColumns({"spent": F.round("spent", 4), "cost_per_validated": F.round("cost_per_validated", 4), "cost_per_source": F.round("cost_per_source", 4)})


@query()
def swapped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a site and day that were recorded twice with name and organizer swapped (tested against brute force)."""
    k = F.col("o_orderkey")
    n = F.floor(k / 2).cast("string")
    a, b = F.concat(F.lit("Lagoon Prize "), n), F.concat(F.lit("Harbour House "), n)
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 2 == 0, a).otherwise(b).alias("title"), F.when(k % 2 == 0, b).otherwise(a).alias("organizer"), F.concat(F.lit("site"), (F.floor(k / 2) % 50).cast("string")).alias("host"), F.lit("1998-01-01").cast("date").alias("day"),
        (F.col("o_custkey") % 3).cast("double").alias("rank"), (k % 3 != 0).alias("pending"))
    return dedupe.swapped_names(rows)


@query(f"""WITH {OPPORTUNITIES} SELECT id::VARCHAR AS id, slug, title, CASE WHEN id % 3 = 0 THEN 'Online' ELSE location END AS location, CASE WHEN id % 4 = 0 THEN 'estimated' WHEN id % 4 = 1 THEN 'unknown' ELSE deadline_status END AS deadline_status, CASE WHEN id % 4 = 0 THEN 'https://raw.org/d' END AS deadline_source_url, coalesce(confidence, 0) AS confidence,
CASE WHEN id % 5 = 0 THEN 'community' ELSE source_type END AS source_type, official_url, CASE WHEN id % 10 = 0 THEN 'unchecked' ELSE official_url_status END AS official_status, official_url IS NOT NULL AND official_url_status IN ('verified', 'redirected') AND id % 10 <> 0 AND coalesce(official_url_http_status BETWEEN 200 AND 399, false) AS official_verified, coalesce(len(string_split(nullif(tags, ''), ',')), 0)::INT AS tags, coalesce(has_conflict, false) AS has_conflict FROM opportunities""")
def record_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stored rows as the catalogue shows them, with defaults and the payload's fields."""
    k = F.col("id")
    rows = opportunities(spark, sf_dir)
    rows = rows.withColumns({
        "location": F.when(k % 3 != 0, F.col("location")), "source_type": F.when(k % 5 != 0, F.col("source_type")), "official_url_status": F.when(k % 10 != 0, F.col("official_url_status")), "deadline_status": F.when(k % 4 > 1, F.col("deadline_status")),
        "raw_payload": F.when(k % 4 == 0, F.lit('{"deadline_status": "estimated", "deadline_source_url": "https://raw.org/d"}')).when(k % 4 == 2, F.lit('{"deadline_status": "rolling", "deadline_source_url": "javascript:x"}')), "deadline_source_url": F.lit(None).cast("string")})
    out = cat.mapped(rows)
    return out.select("id", "slug", "title", "location", "deadline_status", "deadline_source_url", "confidence", "source_type", F.col("official.url").alias("official_url"), F.col("official.status").alias("official_status"), F.col("official.verified").alias("official_verified"), F.size("tags").alias("tags"), "has_conflict")


@query("""WITH p AS (SELECT page_id, 'https://a' || (page_id % 20)::VARCHAR || '.org/p' AS i, CASE WHEN page_id % 3 = 0 THEN 'https://b' || (page_id % 10)::VARCHAR || '.org/' END AS f FROM pages), e AS (SELECT i AS url, page_id FROM p UNION SELECT f, page_id FROM p WHERE f IS NOT NULL),
s AS (SELECT s_suppkey AS canonical_key, CASE WHEN s_suppkey % 2 = 0 THEN 'https://a' || s_suppkey::VARCHAR || '.org/p' ELSE 'https://b' || s_suppkey::VARCHAR || '.org/' END AS url FROM supplier) SELECT canonical_key, string_agg(DISTINCT page_id::VARCHAR, ',' ORDER BY page_id::VARCHAR) AS queries FROM s JOIN e USING (url) GROUP BY 1""")
def unchanged_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK12: how the pages of stored rows were met again."""
    k = F.col("page_id")
    host = lambda c, n: F.concat(F.lit(f"https://{c}"), (k % n).cast("string"), F.lit(".org/"))
    pages = table(spark, sf_dir, "pages").select(F.concat(host("a", 20), F.lit("p?utm_source=x")).alias("input_url"), F.when(k % 3 == 0, host("b", 10)).alias("final_url"), F.array(k.cast("string")).alias("provenance"))
    s = F.col("s_suppkey")
    stored = table(spark, sf_dir, "supplier").select(s.alias("canonical_key"), F.when(s % 2 == 0, F.concat(F.lit("https://a"), s.cast("string"), F.lit(".org/p#top"))).otherwise(F.concat(F.lit("https://b"), s.cast("string"), F.lit(".org"))).alias("source_url"))
    return sinks.page_provenance(pages, stored).select("canonical_key", F.array_join("provenance", ",").alias("queries"))


_SHEET = "'Sheet ' || (l_suppkey % 5)::VARCHAR"


@query(f"""WITH c AS (SELECT {_SHEET} AS sheet, l_orderkey * 10 + l_linenumber AS row, list_filter([l_returnflag, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END, CASE WHEN l_quantity > 25 THEN 'x' END, CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate::VARCHAR END], lambda v: v IS NOT NULL) AS v FROM lineitem WHERE l_linenumber <> 1),
n AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY row) AS rn FROM c), h AS (SELECT sheet, arg_min(row, len(v) * -1000000000000 + row) AS header_row, max(len(v))::INT AS columns FROM n WHERE rn <= 5 GROUP BY 1)
SELECT sheet, count(*) AS nonempty_rows, sum(len(v))::BIGINT AS nonempty_cells, any_value(header_row)::BIGINT AS header_row, any_value(columns) AS columns FROM c JOIN h USING (sheet) GROUP BY 1""")
def workbook_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets with their rows, cells and likely headers."""
    n = F.col("l_linenumber")
    cells = F.array(F.when(n != 1, F.col("l_returnflag")), F.when(n == 1, "").when(n % 2 == 0, F.col("l_linestatus")), F.when((n != 1) & (F.col("l_quantity") > 25), "x"), F.when(n % 3 == 0, F.col("l_shipdate").cast("string")))
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("Sheet "), (F.col("l_suppkey") % 5).cast("string")).alias("sheet"), (F.col("l_orderkey") * 10 + n).alias("row"), cells.alias("values"))
    return readers.inventory(rows).select("sheet", "nonempty_rows", "nonempty_cells", "header_row", F.size("columns").alias("columns"))


@query("SELECT CASE WHEN o_orderkey % 4 < 2 THEN 'series' ELSE 'portal' END AS kind, 'set.xlsx#' || CASE o_orderkey % 4 WHEN 0 THEN 'Dataset' WHEN 1 THEN 'Editions' WHEN 2 THEN 'Sources' ELSE 'Local channels' END AS dataset, count(*) AS rows FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1, 2")
def dataset_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC18: series and portal rows of a data set's sheets."""
    k = F.col("o_orderkey")
    sheet = F.when(k % 5 == 0, "Notes").when(k % 4 == 0, "Dataset").when(k % 4 == 1, "Editions").when(k % 4 == 2, "Sources").otherwise("Local channels")
    sheets = table(spark, sf_dir, "orders").select(sheet.alias("sheet"), k.cast("int").alias("row"), F.create_map(F.lit("name"), F.col("o_orderpriority")).alias("cells"))
    return readers.dataset_rows(sheets, "set.xlsx").groupBy("kind", "dataset").agg(F.count("*").alias("rows"))


_CURATED = [("Lake Fund", "https://lake.org/fund", "fund", ["grant"]), ("Open Board", "https://board.org/", "directory", ["film-festival", "grant"]), ("AI Studio", "https://ai.org/", "creative", ["ai-film"]), ("Board again", "https://board.org/", "news", []), ("House", "https://house.org/", "site", [])]


@query("SELECT * FROM (VALUES ('Lake Fund', 'film-funding', 1::INT, 2880::INT, 1::INT), ('Open Board', 'opportunity-directory', 1, 1440, 2), ('AI Studio', 'ai-creative-tech', 1, 1440, 1), ('House', 'official-site', 2, 4320, 0)) t(name, source_family, tier, poll_interval_minutes, categories)")
def curated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC26: curated sources out of their templates."""
    return readers.catalogue(spark, _CURATED).select("name", "source_family", "tier", "poll_interval_minutes", F.size("opportunity_categories").alias("categories"))


@query("SELECT category, count(*) AS n FROM (VALUES ('AI film festival'), ('Traditional festival'), ('Platform challenge'), ('Grant'), ('Residency'), ('Advertising competition'), ('AI film festival'), ('Grant')) t(category) GROUP BY 1")
def demo_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC24 F7: the catalogue without a table."""
    return readers.demo(spark).groupBy("category").agg(F.count("*").alias("n"))


def _own(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


@query("SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_custkey % 2 = 0")
def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC8 SC25: records written as JSON and read again, those that were wrapped and those that are an array."""
    rows = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    path = _own(spark, "records")
    # a document a segment, as an array or wrapped
    body = F.to_json(F.collect_list(F.struct("id", "segment")))
    wrapped = F.when(F.col("segment") < "F", body).otherwise(F.concat(F.lit('{"records": '), body, F.lit("}")))
    documents = rows.groupBy("segment").agg(wrapped.alias("value")).select("value")
    documents.repartition(5).write.option("lineSep", "\u0001").text(path)
    text = spark.read.text(path, lineSep="\u0001")
    return readers.records_of(text).select(F.variant_get("record", "$.id", "bigint").alias("id"), F.variant_get("record", "$.segment", "string").alias("segment"))


@query("SELECT o_custkey % 10 AS brief, o_orderkey AS item, CASE WHEN o_custkey % 10 < 3 THEN 'new' ELSE 'old' END AS value FROM orders WHERE o_custkey % 10 >= 3 OR o_orderkey % 2 = 0")
def child_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK8: the children of some keys are replaced, the others stay."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("brief"), F.col("o_orderkey").alias("item"))
    path = _own(spark, "children")
    sinks.replace_partitions(rows.withColumn("value", F.lit("old")), path, "brief")
    sinks.replace_partitions(rows.where("brief < 3 and item % 2 = 0").withColumn("value", F.lit("new")), path, "brief")
    return spark.read.parquet(path).select(F.col("brief").cast("bigint").alias("brief"), "item", "value")


@query("SELECT c_mktsegment AS run, count(*) AS records, count_if(c_acctbal < 0)::BIGINT AS rejected FROM customer GROUP BY 1 UNION ALL SELECT 'all', count(*), count_if(c_acctbal < 0)::BIGINT FROM customer")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK10: runs are added to the log with their counters."""
    path = _own(spark, "runs")
    count = [F.count("*").alias("records"), F.count_if(F.col("c_acctbal") < 0).alias("rejected")]
    rows = table(spark, sf_dir, "customer")
    sinks.append_run(rows.groupBy(F.col("c_mktsegment").alias("run")).agg(*count), path)
    sinks.append_run(rows.agg(*count).select(F.lit("all").alias("run"), "records", "rejected"), path)
    return spark.read.parquet(path)


@query("SELECT section, upper(section) || chr(10) || string_agg('- ' || title, chr(10) ORDER BY position) AS text FROM (SELECT s_suppkey AS position, CASE WHEN s_suppkey <= 5 THEN 'action_now' WHEN s_suppkey <= 8 THEN 'changed' ELSE 'watch' END AS section, s_name AS title FROM supplier WHERE s_suppkey <= 10) GROUP BY section")
def brief_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK14: the sections of a brief as text."""
    k = F.col("s_suppkey")
    items = table(spark, sf_dir, "supplier").where(k <= 10).select(k.alias("position"), F.when(k <= 5, "action_now").when(k <= 8, "changed").otherwise("watch").alias("section"), F.col("s_name").alias("title"))
    return sinks.brief_text(items)


_VALUES = ["0", "7", "900", "x", "", "-3", "12abc", "50", "51", "٣"]


@query(f"SELECT v, CASE WHEN regexp_matches(v, '^[0-9]+$') AND v::BIGINT >= 1 THEN least(v::BIGINT, 50) END::BIGINT AS bounded, least(greatest(CASE WHEN regexp_matches(v, '^-?[0-9]+$') THEN v::BIGINT ELSE 24 END, 1), 50)::BIGINT AS page_size, v IN ('7', '14', '30') AS closing FROM (VALUES {', '.join(f'({cases.quoted(v)})' for v in _VALUES)}) t(v)")
def bounded_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters parsed, clamped and checked."""

    def closing(v: str) -> bool:
        try:
            cat.Options(closing_within=int(v) if v.isascii() and v.lstrip("-").isdigit() else -1)
        except ValueError:
            return False
        return True

    number = lambda v: int(v) if v.isascii() and v.lstrip("-").isdigit() else None
    return spark.createDataFrame([(v, cat.bounded_int(v, 1, 50), cat.clamp_page(number(v), 0)[0], closing(v)) for v in _VALUES], "v string, bounded bigint, page_size bigint, closing boolean")


@query("SELECT o_orderkey AS id, least(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 END) AS first, greatest(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 END) AS last, floor(o_totalprice * 10 + 0.5) / 10 AS price FROM orders")
def null_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JM7 JM11: least and greatest of what is known; rounding half up."""
    k = F.col("o_orderkey")
    a, b = F.when(k % 3 != 0, k % 7), F.when(k % 2 == 0, k % 5)
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.least(a, b).alias("first"), F.greatest(a, b).alias("last"), match.rounded(F.col("o_totalprice"), 1).alias("price"))


@query("SELECT DISTINCT o_custkey % 97 AS host FROM orders WHERE o_custkey % 97 NOT IN (SELECT s_suppkey FROM supplier)")
def excluded_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in one set and not in another."""
    hosts = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("host")).distinct()
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("host"))
    return hosts.join(known, "host", "left_anti")
