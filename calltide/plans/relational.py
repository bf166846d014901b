"""Join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins as ops
from .base import NOW, OPPORTUNITIES, SOURCES, moment, opportunities, query, sources, table


@query(f"WITH {OPPORTUNITIES}, u AS (SELECT canonical_key FROM opportunities GROUP BY 1 HAVING count(*) = 1) SELECT id, canonical_key FROM opportunities JOIN u USING (canonical_key)")
def join_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is unique."""
    rows = opportunities(spark, sf_dir, "id", "canonical_key")
    return rows.join(ops.unique_keys(rows, "canonical_key"), "canonical_key").select("id", "canonical_key")


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'unknown') AS segment, coalesce(c_acctbal, 0) AS balance FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup with defaults for missing rows."""
    right = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    left = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return ops.lookup(left, ops.small_side(right), "o_custkey", {"segment": "unknown", "balance": 0.0}).drop("o_custkey")


@query("SELECT l_orderkey, l_linenumber, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity > 45")
def join_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inner lookup that fails where a stored row is missing."""
    left = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    right = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return ops.required(left, right, "s_suppkey", "n_name").select("l_orderkey", "l_linenumber", "n_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 SC4: a keyed scan."""
    keys = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(keys, "o_orderkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was not seen since a time."""
    recent = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= moment("2000-01-01 00:00:00")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(recent, "c_custkey", "left_anti")


@query(f"WITH {OPPORTUNITIES}, {SOURCES}, held AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM sources WHERE id % 5 = 0) SELECT id, canonical_key FROM opportunities WHERE regexp_extract(source_url, '^https?://([^/]+)', 1) NOT IN (SELECT host FROM held) AND canonical_key NOT IN (SELECT concat(id::VARCHAR, '-1') FROM sources)")
def join_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out hosts and series are left out, by two anti joins."""
    from ..functions.url import host

    held = sources(spark, sf_dir, "id", "url")
    rows = opportunities(spark, sf_dir, "id", "canonical_key", "source_url").withColumn("host", host(F.col("source_url")))
    out = rows.join(held.where("id % 5 = 0").select(host(F.col("url")).alias("host")), "host", "left_anti")
    return out.join(held.select(F.concat(F.col("id").cast("string"), F.lit("-1")).alias("canonical_key")), "canonical_key", "left_anti").select("id", "canonical_key")


@query(f"""WITH {OPPORTUNITIES}, {SOURCES},
k AS (SELECT url FROM sources WHERE id % 4 = 0 UNION SELECT concat('https://filmfreeway.com/fest', id::VARCHAR) FROM sources UNION SELECT concat('https://festhome.com/f/', id::VARCHAR) FROM sources)
SELECT DISTINCT id, url AS link FROM opportunities JOIN k ON source_url = url OR official_url = url OR application_url = url""")
def join_or_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of three URL columns."""
    s = sources(spark, sf_dir, "id", "url")
    ident = F.col("id").cast("string")
    keys = s.where("id % 4 = 0").select(F.col("url").alias("link")).union(s.select(F.concat(F.lit("https://filmfreeway.com/fest"), ident))).union(s.select(F.concat(F.lit("https://festhome.com/f/"), ident)))
    rows = opportunities(spark, sf_dir, "id", "source_url", "official_url", "application_url")
    return ops.by_any_column(keys, "link", rows, "id", ["source_url", "official_url", "application_url"]).distinct()


@query(f"""WITH {OPPORTUNITIES}, p AS (SELECT id, organizer, canonical_key, list_distinct(list_filter(string_split(lower(title), ' '), lambda x: length(x) > 2)) AS t FROM opportunities WHERE id < 600)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 6) AS overlap FROM p a JOIN p b ON a.canonical_key = b.canonical_key AND a.id < b.id
WHERE len(a.t) >= 2 AND len(b.t) >= 2 AND len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) >= 0.7""")
def join_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate self join on token overlap in a block. The bound on id is the SQL side's as well."""
    rows = opportunities(spark, sf_dir, "id", "canonical_key", "title").where("id < 600")
    tokens = F.array_distinct(F.filter(F.split(F.lower("title"), " "), lambda x: F.length(x) > 2))
    return ops.token_pairs(rows.withColumn("t", tokens), "id", "t", "canonical_key").withColumn("overlap", F.round("overlap", 6))


@query(f"""WITH {SOURCES}, checkpoints AS (SELECT s_suppkey AS source_id, concat('page-', (s_suppkey % 4)::VARCHAR) AS cursor, s_acctbal AS state FROM supplier WHERE s_suppkey % 2 = 0)
SELECT id, coalesce(cursor, 'page-0') AS cursor, coalesce(state, 0) AS state FROM sources LEFT JOIN checkpoints ON id = source_id""")
def join_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their checkpoint or the default one."""
    c = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("page-"), (F.col("s_suppkey") % 4).cast("string")).alias("cursor"), F.col("s_acctbal").alias("state"))
    return ops.lookup(sources(spark, sf_dir, "id"), c, "id", {"cursor": "page-0", "state": 0.0})


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)
SELECT o_orderkey, count(rn)::BIGINT AS children, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY rn), '') AS parts FROM orders LEFT JOIN r ON o_orderkey = l_orderkey AND rn <= 3 GROUP BY o_orderkey""")
def join_record_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record with its latest children, ordered and limited."""
    order = [F.desc("l_shipdate"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice")]
    kids = ops.latest_children(table(spark, sf_dir, "lineitem"), "l_orderkey", order, 3, ["l_partkey"], "kids")
    out = table(spark, sf_dir, "orders").select("o_orderkey").join(kids, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", F.greatest(F.coalesce(F.size("kids"), F.lit(0)), F.lit(0)).cast("bigint").alias("children"), F.coalesce(F.array_join("kids.l_partkey", ","), F.lit("")).alias("parts"))


@query(f"""WITH {OPPORTUNITIES}, {SOURCES}, d AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS site, 'site list' AS name FROM sources WHERE source_family = 'opportunity-directory' UNION SELECT 'calls.example.net', 'All calls')
SELECT d.site, count(DISTINCT organizer)::BIGINT AS organizers, (any_value(d.name) = 'All calls' OR count(DISTINCT organizer) >= 3) AS aggregator FROM d LEFT JOIN opportunities o ON regexp_extract(o.source_url, '^https?://([^/]+)', 1) = d.site GROUP BY d.site""")
def join_aggregators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory sites that hold many organizers' calls."""
    from ..functions.url import host

    records = opportunities(spark, sf_dir, "organizer", "source_url").select("organizer", host(F.col("source_url")).alias("site"))
    dirs = sources(spark, sf_dir, "url", "source_family").where("source_family = 'opportunity-directory'").select(host(F.col("url")).alias("site"), F.lit("site list").alias("name")).distinct()
    dirs = dirs.union(spark.createDataFrame([("calls.example.net", "All calls")], "site string, name string"))
    return ops.aggregators(records, dirs)


@query(f"""WITH {OPPORTUNITIES}, t AS (SELECT c_custkey AS truth, concat(c_custkey::VARCHAR, '-2') AS canonical_key, concat('site', (c_custkey % 97)::VARCHAR, '.example.org') AS host, ['film', 'prize', lower(c_mktsegment)] AS w FROM customer),
o AS (SELECT id, canonical_key, regexp_extract(source_url, '^https?://([^/]+)', 1) AS host, list_distinct(list_filter(string_split(lower(title), ' '), lambda x: length(x) > 2)) AS k FROM opportunities),
d AS (SELECT truth, min(id) AS id FROM t JOIN o USING (canonical_key) GROUP BY 1),
l AS (SELECT truth, min(id) AS id FROM t JOIN o USING (host) WHERE len(list_intersect(w, k)) / least(len(w), len(k)) >= 0.5 GROUP BY 1)
SELECT truth, coalesce(d.id, l.id) AS matched, CASE WHEN d.id IS NOT NULL THEN 'key' WHEN l.id IS NOT NULL THEN 'host' END AS how FROM t LEFT JOIN d USING (truth) LEFT JOIN l USING (truth)""")
def join_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11 TX9 TX10: match by key, else by host and token overlap, first match wins."""
    from ..functions.url import host

    k = F.col("c_custkey")
    truth = table(spark, sf_dir, "customer").select(
        k.alias("truth"), F.concat(k.cast("string"), F.lit("-2")).alias("canonical_key"),
        F.array(F.concat(F.lit("site"), (k % 97).cast("string"), F.lit(".example.org"))).alias("hosts"), F.array(F.lit("film"), F.lit("prize"), F.lower("c_mktsegment")).alias("tokens"))
    rows = opportunities(spark, sf_dir, "id", "canonical_key", "source_url", "title")
    rows = rows.select("id", "canonical_key", host(F.col("source_url")).alias("host"), F.array_distinct(F.filter(F.split(F.lower("title"), " "), lambda x: F.length(x) > 2)).alias("tokens"))
    return ops.first_match(truth, rows, "truth", "id", "canonical_key")


@query("""SELECT c_custkey, (c_custkey % 97) IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) OR (c_custkey % 97 + 1) IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) OR c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey = 4) AS known FROM customer""")
def join_any_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered by any host or by key."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.array((F.col("c_custkey") % 97), F.col("c_custkey") % 97 + 1).alias("hosts"))
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("host"))
    keys = c.where("c_custkey = 4").select("c_mktsegment")
    return ops.any_known(c, "c_custkey", "hosts", "c_mktsegment", known, keys)


@query("""SELECT user_id, arg_min(event_type, (CAST(floor(value / 50) AS INT) * 10, -epoch_us(ts), event_id)) AS event_type, min(CAST(floor(value / 50) AS INT) * 10) AS priority,
 CAST(arg_min(event_id, (CAST(floor(value / 50) AS INT) * 10, -epoch_us(ts), event_id)) AS BIGINT) AS seq FROM events GROUP BY user_id""")
def latest_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J22 ST8: the claim that holds now, by priority, then time."""
    claims = table(spark, sf_dir, "events").select("user_id", "event_type", (F.floor(F.col("value") / 50).cast("int") * 10).alias("priority"), F.col("ts").alias("observed_at"), F.col("event_id").alias("seq"))
    return ops.current_claim(claims, "user_id", "event_type").select("user_id", "event_type", "priority", "seq")


@query(f"WITH {OPPORTUNITIES} SELECT id FROM opportunities WHERE verified_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND verified_at <= TIMESTAMP '{NOW}' AND discovered_at >= date_trunc('month', TIMESTAMP '{NOW}')")
def range_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J23 DT11: interval predicates and month truncation."""
    now = moment(NOW)
    rows = opportunities(spark, sf_dir, "id", "verified_at", "discovered_at")
    return rows.where((F.col("verified_at") >= now - F.expr("INTERVAL 7 DAY")) & (F.col("verified_at") <= now) & (F.col("discovered_at") >= F.date_trunc("month", now).cast("timestamp_ntz"))).select("id")
