"""Metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import base_domain, host
from ..operators import metrics as ops
from .base import NOW, OPPORTUNITIES, SOURCES, moment, opportunities, query, sources, table

_USAGE = """usage AS (SELECT event_id, ts AS occurred_at, CASE WHEN user_id % 2 = 0 THEN 'exa' ELSE 'cloudflare' END AS provider, event_type AS operation,
 CASE event_id % 5 WHEN 0 THEN 'reserved' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'blocked' ELSE 'succeeded' END AS status, props AS units, value / 100 AS cost, value / 90 AS reserved_cost FROM events)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of the usage ledger."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("occurred_at"), F.expr("CASE WHEN user_id % 2 = 0 THEN 'exa' ELSE 'cloudflare' END").alias("provider"), F.col("event_type").alias("operation"),
        F.expr("CASE event_id % 5 WHEN 0 THEN 'reserved' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'blocked' ELSE 'succeeded' END").alias("status"),
        F.col("props").alias("units"), (F.col("value") / 100).alias("cost"), (F.col("value") / 90).alias("reserved_cost"))


@query(f"WITH {OPPORTUNITIES}, k AS (SELECT unnest(['AI film festival','Grant','Workshop']) AS label), g AS (SELECT category AS label, count(*) AS n FROM opportunities GROUP BY 1) SELECT label, coalesce(n, 0)::BIGINT AS n FROM k FULL JOIN g USING (label)")
def count_by_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with zeros for expected labels."""
    return ops.count_by(opportunities(spark, sf_dir, "category"), F.col("category"), ["AI film festival", "Grant", "Workshop"])


_EXPIRED = f"(status = 'closed' OR coalesce(deadline < TIMESTAMP '{NOW}', false))"
_UPCOMING = f"(NOT {_EXPIRED} AND coalesce(opens_at > TIMESTAMP '{NOW}', false))"


@query(f"""WITH {OPPORTUNITIES} SELECT count(*) AS total, count_if({_EXPIRED})::BIGINT AS expired, count_if({_UPCOMING})::BIGINT AS upcoming, count_if(NOT {_EXPIRED} AND NOT {_UPCOMING})::BIGINT AS active,
count_if(deadline IS NULL OR deadline_status = 'unknown')::BIGINT AS unknown, count_if(status IN ('verified','open','closing-soon'))::BIGINT AS published FROM opportunities""")
def audit_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's states in one pass."""
    return ops.audit_buckets(opportunities(spark, sf_dir), moment(NOW))


_FIELDS = ["deadline", "application_url", "eligibility", "entry_fee_amount", "max_runtime_minutes", "official_url", "review_reason"]


@query(f"WITH {OPPORTUNITIES}, g AS (SELECT 'all' AS grp, * FROM opportunities UNION ALL SELECT review_decision, * FROM opportunities WHERE review_decision IN ('approved','pending')), f AS ("
       + " UNION ALL ".join(f"SELECT grp, '{f}' AS field, count_if({f} IS NOT NULL AND {f}::VARCHAR <> '')::BIGINT AS n, count(*) AS total FROM g GROUP BY grp" for f in _FIELDS) + ") SELECT *, round(n * 100.0::DOUBLE / total, 1) AS pct FROM f")
def field_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of seven fields for three groups, one aggregation."""
    groups = {"all": F.lit(True), "approved": F.col("review_decision") == "approved", "pending": F.col("review_decision") == "pending"}
    return ops.completeness(opportunities(spark, sf_dir, "review_decision", *_FIELDS), _FIELDS, groups)


@query("""WITH g AS (SELECT text AS k, count(*) AS size, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY text HAVING count(*) > 1), t AS (SELECT count(*) AS all_groups, coalesce(sum(size), 0)::BIGINT AS all_rows FROM g)
SELECT substring(sha256(k), 1, 16) AS digest, size, first_id, last_id, all_groups, all_rows FROM g, t ORDER BY size DESC, first_id LIMIT 100""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 JM9: the hundred largest groups of equal texts (a top-k report), totals over all."""
    return ops.duplicate_groups(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query(f"""WITH {_USAGE} SELECT provider, operation, count(*) AS events, count_if(status = 'succeeded')::BIGINT AS succeeded, count_if(status = 'uncertain')::BIGINT AS uncertain, count_if(status = 'blocked')::BIGINT AS blocked,
sum(coalesce(try_cast(units->>'$.k' AS BIGINT), 0))::BIGINT AS units, round(sum(CASE WHEN status <> 'blocked' THEN cost ELSE 0 END), 2) AS cost FROM usage GROUP BY 1, 2""")
def usage_by_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage ledger by provider and operation."""
    return ops.usage_ledger(usage(spark, sf_dir))


@query(f"""WITH {_USAGE} SELECT CASE WHEN provider = 'exa' THEN 'exa' ELSE 'core' END AS pool, round(sum(CASE WHEN status = 'reserved' THEN reserved_cost ELSE coalesce(cost, 0) END), 2) AS spend
FROM usage WHERE status IN ('reserved','succeeded','uncertain') AND occurred_at >= TIMESTAMP '2024-01-10' GROUP BY 1""")
def spend_by_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month's spend of the two pools."""
    return ops.spend_by_pool(usage(spark, sf_dir), moment("2024-01-10 00:00:00"))


@query("SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, sum(coalesce(try_cast(props->>'$.k' AS BIGINT), 0))::BIGINT AS units FROM events GROUP BY 1")
def json_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 JM1: daily sums of a JSON value."""
    units = F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"), F.lit(0))
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.sum(units).alias("units"))


@query("""WITH g AS (SELECT l_returnflag, l_linestatus, sum(l_linenumber) AS checks, sum(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS finds, sum(CASE WHEN l_quantity > 48 THEN 1 ELSE 0 END) AS wrong, sum(l_quantity) AS cost FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, checks::BIGINT AS checks, finds::BIGINT AS finds, round(finds * 100.0::DOUBLE / checks, 4) AS finds_per_100, round(cost / nullif(finds, 0), 4) AS cost_per_find, round(wrong::DOUBLE / nullif(finds, 0), 4) AS false_rate FROM g""")
def economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and unit costs, null where nothing was counted."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_linenumber").alias("c"), F.when(F.col("l_quantity") > 40, 1).otherwise(0).alias("f"), F.when(F.col("l_quantity") > 48, 1).otherwise(0).alias("w"), "l_quantity")
    return ops.economics(rows, ["l_returnflag", "l_linestatus"], "c", "f", "w", "l_quantity")


@query("""WITH h AS (SELECT l_suppkey AS query_id, l_partkey AS item, l_orderkey * 10 + l_linenumber AS rank, concat('https://www.h', (l_partkey % 50)::VARCHAR, '.example.org/', (l_partkey % 400)::VARCHAR) AS url FROM lineitem),
f AS (SELECT item, arg_min(query_id, (rank, query_id)) AS query_id FROM h GROUP BY item), c AS (SELECT query_id, count(*) AS validated FROM f GROUP BY 1)
SELECT h.query_id, count(DISTINCT url) AS admitted, count(DISTINCT regexp_replace(regexp_extract(url, '//([^/]+)', 1), '^www\\.', '')) AS hosts, coalesce(any_value(validated), 0)::BIGINT AS validated FROM h LEFT JOIN c USING (query_id) GROUP BY 1""".replace("\\\\", "\\"))
def query_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yield of queries; a validated item is credited to its first hit."""
    p = F.col("l_partkey")
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), p.alias("item"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"), F.concat(F.lit("https://www.h"), (p % 50).cast("string"), F.lit(".example.org/"), (p % 400).cast("string")).alias("url"))
    return ops.query_yield(hits)


_RECALL = "count(*) AS total, count_if(hit)::BIGINT AS matched, round(count_if(hit)::DOUBLE / count(*), 4) AS recall, round(count_if(hit) * 100.0::DOUBLE / count(*), 2) AS percent"


@query(f"""WITH {OPPORTUNITIES}, b AS (SELECT *, id % 3 = 0 AS hit FROM opportunities)
SELECT 'overall' AS dimension, 'all' AS label, {_RECALL} FROM b UNION ALL SELECT 'category', category, {_RECALL} FROM b GROUP BY category
UNION ALL SELECT 'eligibility', coalesce(eligibility, 'Unknown'), {_RECALL} FROM b GROUP BY 2 UNION ALL SELECT 'status', status, {_RECALL} FROM b GROUP BY status""")
def recall_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall overall and by three dimensions in one pass."""
    rows = opportunities(spark, sf_dir, "id", "category", "eligibility", "status").withColumn("hit", F.col("id") % 3 == 0)
    return ops.grouped_recall(rows, ["category", "eligibility", "status"], "hit")


@query("""WITH k AS (SELECT c_custkey, ('0x' || substring(sha256('coverage-holdout' || chr(31) || c_name), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 AS held FROM customer),
f AS (SELECT k.*, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS found, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS published, c_custkey % 3 = 0 AS registered FROM k),
g AS (SELECT CASE WHEN held THEN 'heldout' ELSE 'seeded' END AS part, * FROM f UNION ALL SELECT 'all', * FROM f)
SELECT part, count(*) AS total, count_if(registered)::BIGINT AS registered, count_if(found)::BIGINT AS found, count_if(published)::BIGINT AS published, round(count_if(found) * 100.0::DOUBLE / count(*), 1) AS found_pct FROM g GROUP BY part""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 E4 JB11: coverage of held-out and seeded series, by rollup."""
    from ..functions.scoring import held_out_by_hash

    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit(True).alias("f"), F.bool_or(F.col("o_orderstatus") == "F").alias("p"))
    c = table(spark, sf_dir, "customer").select("c_custkey", held_out_by_hash(F.col("c_name"), "coverage-holdout").alias("held")).join(o, "c_custkey", "left")
    yes = lambda x: F.coalesce(F.col(x), F.lit(False))
    found = F.count_if(yes("f"))
    part = F.when(F.grouping("held") == 1, "all").when(F.col("held"), "heldout").otherwise("seeded")
    out = c.rollup("held").agg(F.count("*").alias("total"), F.count_if(F.col("c_custkey") % 3 == 0).alias("registered"), found.alias("found"), F.count_if(yes("p")).alias("published"), ops.pct(found, F.count("*")).alias("found_pct"), part.alias("part"))
    return out.drop("held")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01'),
n AS (SELECT (SELECT count(*) FROM a) AS n1, (SELECT count(*) FROM b) AS n2, (SELECT count(*) FROM a JOIN b USING (k)) AS m) SELECT n1, n2, m, floor((n1 + 1) * (n2 + 1) / (m + 1) - 1 + 0.5)::BIGINT AS estimate FROM n""")
def capture_recapture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Chapman estimate from two captures, with their overlap."""
    day = F.col("o_orderdate")
    caught = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(day < moment("1997-01-01 00:00:00")).alias("a"), F.bool_or(day >= moment("2000-06-01 00:00:00")).alias("b"))
    n = caught.agg(F.count_if("a").alias("n1"), F.count_if("b").alias("n2"), F.count_if(F.col("a") & F.col("b")).alias("m"))
    return n.select("n1", "n2", "m", ops.chapman(F.col("n1"), F.col("n2"), F.col("m")).alias("estimate"))


@query("""WITH h AS (SELECT regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '^www\\.', '') AS host, page_id FROM pages), d AS (SELECT array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS host, page_id FROM h)
SELECT host, count(DISTINCT page_id) AS series FROM d GROUP BY host HAVING count(DISTINCT page_id) >= 3""")
def channel_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that carry three or more series."""
    return ops.channel_hosts(table(spark, sf_dir, "pages").select(base_domain(host(F.col("url"))).alias("host"), "page_id"), "page_id")


@query(f"""WITH {SOURCES}, r AS (SELECT concat('site', (id % 200)::VARCHAR) AS key, id AS seq, priority, tier, poll_interval_minutes AS poll, min_poll_interval_minutes AS min_poll, max_poll_interval_minutes AS max_poll, next_check_at, country, source_family, health_status AS category FROM sources)
SELECT key, min(priority) AS priority, min(tier) AS tier, min(poll) AS poll, min(min_poll) AS min_poll, greatest(max(max_poll), min(poll)) AS max_poll, min(next_check_at)::VARCHAR AS next_check_at, arg_min(country, seq) FILTER (country IS NOT NULL) AS country,
coalesce(arg_min(source_family, seq) FILTER (source_family <> 'official-site'), 'official-site') AS source_family, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories FROM r GROUP BY key""")
def seed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed rows of a URL merged into one."""
    s = sources(spark, sf_dir)
    rows = s.select(F.concat(F.lit("site"), (F.col("id") % 200).cast("string")).alias("key"), F.col("id").alias("seq"), "priority", "tier", F.col("poll_interval_minutes").alias("poll"), F.col("min_poll_interval_minutes").alias("min_poll"), F.col("max_poll_interval_minutes").alias("max_poll"), "next_check_at", "country", "source_family", F.col("health_status").alias("category"))
    return ops.merge_seeds(rows, "key").withColumns({"next_check_at": F.col("next_check_at").cast("string"), "categories": F.array_join("categories", ",")})


@query("""WITH r AS (SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, upper(event_type) AS reason, count(*) AS n FROM events WHERE value < 50 GROUP BY 1, 2)
SELECT day, sum(n)::BIGINT AS rejected, string_agg(reason || '=' || n, ';' ORDER BY reason || '=' || n) AS reasons FROM r GROUP BY day""")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects by reason as a sorted map."""
    e = table(spark, sf_dir, "events").where("value < 50").select(F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("reason"), F.lit(1).alias("n"))
    return ops.reason_map(e, ["day"])


@query("SELECT count(*) AS runs, max(CASE WHEN event_type = 'view' THEN event_id END) AS last_view, max(CASE WHEN event_type = 'signup' THEN event_id END) AS last_signup FROM events")
def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run of each kind."""
    return ops.health(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("finished_at")), ["view", "signup"])


@query("""SELECT user_id, count(*) AS seen_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(DISTINCT date_trunc('day', ts)) > 1 AS recurring, min(year(ts))::INT AS earliest, max(year(ts))::INT AS latest FROM events GROUP BY user_id""")
def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26 A27 ST11: first and last seen, counts and ranges."""
    e, fmt = table(spark, sf_dir, "events"), "yyyy-MM-dd HH:mm:ss"
    return e.groupBy("user_id").agg(
        F.count("*").alias("seen_count"), F.date_format(F.min("ts"), fmt).alias("first_seen"), F.date_format(F.max("ts"), fmt).alias("last_seen"),
        (F.count_distinct(F.to_date("ts")) > 1).alias("recurring"), F.min(F.year("ts")).alias("earliest"), F.max(F.year("ts")).alias("latest"))


@query("""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '#.*$', ''), '\\?.*$', '') AS page FROM pages) SELECT page_id, page FROM c WHERE page IN (SELECT page FROM c GROUP BY page HAVING count(*) = 1)""")
def shared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose page nobody else has."""
    page = F.regexp_replace(F.regexp_replace(F.lower("url"), "#.*$", ""), r"\?.*$", "")
    return ops.shared_pages(table(spark, sf_dir, "pages").select("page_id", "url"), page, "page_id")


@query(f"WITH {OPPORTUNITIES} SELECT regexp_extract(source_url, '^https?://([^/]+)', 1) AS site, count(DISTINCT title) AS titles, string_agg(DISTINCT title, '|' ORDER BY title) AS title_list FROM opportunities GROUP BY 1")
def titles_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles of each site."""
    rows = opportunities(spark, sf_dir, "source_url", "title").select(host(F.col("source_url")).alias("site"), "title").distinct()
    return rows.groupBy("site").agg(F.count("*").alias("titles"), F.array_join(F.array_sort(F.collect_list("title")), "|").alias("title_list"))


@query("SELECT m AS multiplier, round(least(5.0::DOUBLE, m * 30 * 12 * 0.005::DOUBLE), 4) AS cost FROM (SELECT unnest([1, 2, 5, 10]) AS m)")
def cost_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured cost at several scales, capped by the budget."""
    return ops.cost_projection(30, 12, 0.005, 5.0, (1, 2, 5, 10), spark.range(1))


@query("""WITH b AS (SELECT o_orderkey, map {'status': o_orderstatus, 'priority': o_orderpriority, 'price': o_totalprice::BIGINT::VARCHAR} AS old, map {'status': 'F', 'priority': o_orderpriority, 'price': CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice::BIGINT::VARCHAR END} AS new FROM orders)
SELECT o_orderkey, array_to_string(list_filter(['price','priority','status'], lambda k: old[k] IS DISTINCT FROM new[k]), ',') AS changed FROM b""")
def audit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21 JM12: changed keys between two records, null-safe."""
    from ..operators.state import changed_keys

    price = F.round("o_totalprice").cast("bigint").cast("string")
    old = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority", F.lit("price"), price)
    new = F.create_map(F.lit("status"), F.lit("F"), F.lit("priority"), "o_orderpriority", F.lit("price"), F.when(F.col("o_orderkey") % 2 == 0, price))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(changed_keys(old, new), ",").alias("changed"))


@query("""SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS last_20 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20 GROUP BY user_id""")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty elements of each key."""
    from ..operators.joins import latest_children

    last = latest_children(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 20, ["event_id"], "e")
    return last.select("user_id", F.array_join(F.reverse("e.event_id"), ",").alias("last_20"))


