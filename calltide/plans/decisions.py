"""Decision tables and state queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import state as ops
from .base import NOW, OPPORTUNITIES, SOURCES, moment, opportunities, query, sources, table

_OFFICIAL = "(coalesce(official_url IS NOT NULL AND official_url_status IN ('verified','redirected'), false) OR coalesce(source_type = 'official' AND source_url_status IN ('verified','redirected'), false))"
_NO_ORG = "lower(trim(coalesce(organizer, ''))) IN ('', 'unknown', 'unknown organizer')"
_TEAM = "(tags LIKE 'platform:festhome%' OR tags LIKE 'festhome:%')"


def _blockers(status: str) -> str:
    return f"""list_filter([CASE WHEN {status} NOT IN ('verified','open','closing-soon') THEN 'status-not-public' END, CASE WHEN trim(title) = '' THEN 'missing-title' END, CASE WHEN {_NO_ORG} THEN 'missing-organizer' END,
CASE WHEN NOT {_OFFICIAL} THEN 'no-verified-official-page' END, CASE WHEN has_conflict THEN 'unresolved-conflict' END,
CASE WHEN deadline <= TIMESTAMP '{NOW}' THEN 'deadline-passed' WHEN {status} IN ('open','closing-soon') AND deadline_status <> 'rolling' AND (deadline IS NULL OR deadline_status <> 'confirmed') THEN 'deadline-not-confirmed' END,
CASE WHEN {status} = 'closing-soon' AND deadline IS NULL THEN 'closing-soon-without-deadline' END, CASE WHEN {_TEAM} THEN 'team-only-source' END], lambda x: x IS NOT NULL)"""


@query(f"WITH {OPPORTUNITIES} SELECT id, array_to_string({_blockers('status')}, ',') AS blockers FROM opportunities")
def publication_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps each record from being published."""
    return opportunities(spark, sf_dir).select("id", F.array_join(scoring.blockers(F.col("status"), moment(NOW)), ",").alias("blockers"))


@query(f"""WITH {OPPORTUNITIES} SELECT id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.18::DOUBLE + CASE WHEN source_url_status IN ('verified','redirected') THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN source_type = 'official' THEN 0.12::DOUBLE ELSE 0 END
+ CASE WHEN official_url IS NOT NULL AND official_url_status <> 'invalid' THEN 0.17::DOUBLE ELSE 0 END + CASE WHEN application_url IS NOT NULL THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN deadline IS NOT NULL AND deadline_status = 'confirmed' THEN 0.12::DOUBLE ELSE 0 END
+ CASE WHEN summary <> '' THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN eligibility IS NOT NULL THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN tags <> '' THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN location <> 'Unspecified' THEN 0.03::DOUBLE ELSE 0 END + least(greatest(confidence * 0.02::DOUBLE, 0), 0.02::DOUBLE))), 3) AS score FROM opportunities""")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-1 R1: the additive confidence of a record."""
    return opportunities(spark, sf_dir).select("id", scoring.confidence_score().alias("score"))


_D = f"((epoch_us(deadline) - epoch_us(TIMESTAMP '{NOW}')) / 86400000000.0::DOUBLE)"


@query(f"""WITH {OPPORTUNITIES}, b AS (SELECT *, {_blockers("'verified'")} AS loose, {_blockers("'open'")} AS strict, {_D} AS days, coalesce(deadline_status = 'rolling', false) AS rolling, coalesce(contains(review_reason, 'false-positive candidate'), false) AS generic FROM opportunities),
t AS (SELECT *, coalesce(days < -2 AND NOT rolling, false) AS gone, coalesce(days > 0, false) AND NOT rolling AS future FROM b),
s AS (SELECT *, CASE WHEN len(loose) = 0 THEN 40 ELSE 0 END + CASE WHEN len(loose) = 0 AND len(strict) = 0 THEN 15 ELSE 0 END - CASE WHEN has_conflict THEN 10 ELSE 0 END + CASE WHEN future AND days <= 45 THEN 15 WHEN future AND days <= 90 THEN 8 ELSE 0 END
 + 3 * ((deadline IS NOT NULL OR rolling)::INT + (max_runtime_minutes IS NOT NULL)::INT + (ai_policy <> 'unclear')::INT + (entry_fee_amount IS NOT NULL)::INT + (application_url IS NOT NULL)::INT + (eligibility IS NOT NULL)::INT)
 + floor(least(greatest(confidence, 0), 1) * 10 + 0.5::DOUBLE) - CASE WHEN generic THEN 30 ELSE 0 END AS points FROM t)
SELECT id, CASE WHEN gone THEN 'deadline-passed' WHEN status = 'closed' THEN 'closed' END AS archive, CASE WHEN gone OR status = 'closed' THEN 0 ELSE least(greatest(points, 0), 100)::INT END AS score,
CASE WHEN gone THEN 'deadline-passed' WHEN status = 'closed' THEN 'closed' ELSE array_to_string(list_filter([CASE WHEN {_TEAM} THEN 'team-only' END, CASE WHEN len(loose) = 0 THEN 'publishable' END, CASE WHEN list_contains(loose, 'no-verified-official-page') THEN 'needs-official-url' END,
 CASE WHEN list_contains(loose, 'missing-organizer') THEN 'missing-organizer' END, CASE WHEN has_conflict THEN 'conflict' END, CASE WHEN deadline IS NULL AND NOT rolling THEN 'needs-deadline' END, CASE WHEN future AND days <= 14 THEN 'closing-soon' END, CASE WHEN generic THEN 'generic-page' END], lambda x: x IS NOT NULL), ',') END AS flags FROM s""")
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-2 R2 JB7: archive, score and flags of a record."""
    return opportunities(spark, sf_dir).withColumn("t", scoring.triage(moment(NOW))).select("id", "t.archive", "t.score", F.array_join("t.flags", ",").alias("flags"))


@query(f"WITH {OPPORTUNITIES} SELECT count_if(deadline_status = 'confirmed' AND deadline < TIMESTAMP '{NOW}' AND status <> 'closed')::BIGINT AS past_deadline, count_if(last_checked_at IS NULL OR last_checked_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY)::BIGINT AS unchecked, count_if(source_url_status IN ('invalid','unreachable') OR official_url_status IN ('invalid','unreachable'))::BIGINT AS broken_links FROM opportunities")
def stale_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16 E6 JB13: three counts in one pass."""
    now = moment(NOW)
    past = (F.col("deadline_status") == "confirmed") & (F.col("deadline") < now) & (F.col("status") != "closed")
    return opportunities(spark, sf_dir).agg(F.count_if(past).alias("past_deadline"), F.count_if(F.col("last_checked_at").isNull() | (F.col("last_checked_at") < now - F.expr("INTERVAL 90 DAY"))).alias("unchecked"), F.count_if(scoring.stale()["broken_links"]).alias("broken_links"))


@query(f"WITH {OPPORTUNITIES} SELECT id FROM opportunities WHERE deadline_status <> 'rolling' AND deadline < TIMESTAMP '{NOW}' - INTERVAL 1 DAY")
def expired_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deadlines more than a day ago."""
    return opportunities(spark, sf_dir, "id", "deadline", "deadline_status").where((F.col("deadline_status") != "rolling") & (F.col("deadline") < moment(NOW) - F.expr("INTERVAL 1 DAY"))).select("id")


@query(f"""WITH {OPPORTUNITIES} SELECT CASE WHEN coalesce(official_url, '') = '' THEN 'missing' WHEN official_url_status = 'invalid' OR official_url_http_status IN (404, 410) THEN 'invalid' WHEN official_url_status = 'unreachable' OR official_url_http_status >= 500 THEN 'unreachable'
WHEN official_url_status = 'verified' THEN 'verified' WHEN official_url_status = 'unchecked' AND official_url_http_status IS NULL THEN 'unchecked' WHEN official_url_http_status IN (200,301,302,307,308) THEN 'verified-metadata-missing' ELSE 'needs-review' END AS link, count(*) AS n FROM opportunities GROUP BY 1""")
def link_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by audit class."""
    rows = opportunities(spark, sf_dir, "official_url", "official_url_status", "official_url_http_status")
    return rows.groupBy(scoring.link_class(F.col("official_url"), F.col("official_url_status"), F.col("official_url_http_status")).alias("link")).agg(F.count("*").alias("n"))


@query(f"""WITH {SOURCES}, p AS (SELECT *, CASE id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'blocked' ELSE 'ok' END AS outcome, id % 5 AS finds, id % 2 = 0 AS changed FROM sources)
SELECT id, CASE WHEN outcome = 'blocked' THEN max_poll_interval_minutes ELSE least(greatest(floor(poll_interval_minutes * CASE WHEN outcome = 'failed' THEN pow(2, least(consecutive_failures + 1, 5)) WHEN finds >= 3 THEN 0.5::DOUBLE WHEN finds >= 1 THEN 0.7::DOUBLE WHEN changed THEN 0.85::DOUBLE
WHEN consecutive_no_change >= 8 THEN 2 WHEN consecutive_no_change >= 3 THEN 1.5::DOUBLE ELSE 1.15::DOUBLE END + 0.5::DOUBLE), min_poll_interval_minutes), max_poll_interval_minutes) END::INT AS minutes,
CASE WHEN outcome = 'blocked' THEN 'blocked' WHEN consecutive_failures >= 3 THEN 'failing' WHEN consecutive_failures > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM p""")
def adaptive_polling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-6 ST5 R5: the next interval and health of each source."""
    c = F.col
    s = sources(spark, sf_dir).withColumn("outcome", F.expr("CASE id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'blocked' ELSE 'ok' END"))
    minutes = scoring.poll_interval(c("outcome"), c("poll_interval_minutes"), c("consecutive_failures"), c("id") % 5, c("id") % 2 == 0, c("consecutive_no_change"), c("min_poll_interval_minutes"), c("max_poll_interval_minutes"))
    return s.select("id", minutes.alias("minutes"), ops.health_after(c("outcome"), c("consecutive_failures")).alias("health"))


@query("SELECT event_id, (15 * pow(2, least(greatest(event_id % 12, 1) - 1, 7)))::INT AS raw, least(1440, (15 * pow(2, least(greatest(event_id % 12, 1) - 1, 7)))::INT) AS minutes, least(greatest(event_id % 200, 1), 168) AS hours FROM events")
def failure_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3 ST4 R17: backoff after failures, and deferral."""
    n = F.greatest(F.col("event_id") % 12, F.lit(1))
    raw = (F.lit(15) * F.pow(F.lit(2), F.least(n - 1, F.lit(7)))).cast("int")
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), ops.failure_backoff(n).cast("int").alias("minutes"), ops.defer_hours(F.col("event_id") % 200).alias("hours"))


@query("""WITH o AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, user_id, (before IS NULL OR before <> event_type) AS changed FROM o""")
def hash_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 ST2 ST12 F12: observations whose content differs from the last."""
    return ops.hash_changes(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "event_type", "ts", "event_id").select("event_id", "user_id", "changed")


@query("""WITH RECURSIVE q AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'exa' ELSE 'core' END || '/' || strftime(ts, '%Y-%m') AS key, ts, event_id AS seq, strftime(ts, '%Y-%m-%d') AS day, value / 1000 AS cost, coalesce((props->>'$.k')::BIGINT, 0) AS units, event_type = 'view' AS optional, user_id::VARCHAR || '-' || (event_id // 3)::VARCHAR AS idem FROM events),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS rn, row_number() OVER (PARTITION BY key, idem ORDER BY ts, seq) > 1 AS replay FROM q),
f AS (SELECT key, 0::BIGINT AS rn, NULL::BIGINT AS seq, ''::VARCHAR AS decision, 0::DOUBLE AS spent, ''::VARCHAR AS day, 0::BIGINT AS used FROM n GROUP BY key
UNION ALL SELECT key, rn, seq, decision, CASE WHEN decision = 'reserved' THEN spent + cost ELSE spent END, day, CASE WHEN decision = 'reserved' THEN used + units ELSE used END FROM (
SELECT n.key, n.rn, n.seq, f.spent, n.cost, n.units, n.day, CASE WHEN n.day = f.day THEN f.used ELSE 0 END AS used, CASE WHEN n.replay THEN 'idempotent-replay' WHEN n.cost > 0 AND f.spent + n.cost > 9 THEN 'monthly-hard-cap' WHEN n.cost > 0 AND n.optional AND f.spent + n.cost >= 8.1::DOUBLE THEN 'optional-disabled'
WHEN CASE WHEN n.day = f.day THEN f.used ELSE 0 END + n.units > 2000 THEN 'daily-provider-limit' ELSE 'reserved' END AS decision FROM f JOIN n ON n.key = f.key AND n.rn = f.rn + 1))
SELECT key, seq, decision, round(spent, 6) AS spent FROM f WHERE rn > 0""")
def budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9 R10: reservations under monthly and daily limits, an ordered fold."""
    e = table(spark, sf_dir, "events")
    key = F.concat(F.when(F.col("user_id") % 2 == 0, "exa").otherwise("core"), F.lit("/"), F.date_format("ts", "yyyy-MM"))
    units = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0))
    idem = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(F.col("event_id") / 3).cast("string"))
    req = e.select(key.alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("value") / 1000).alias("cost"), units.alias("units"), (F.col("event_type") == "view").alias("optional"), idem.alias("idem"))
    return ops.budget_ledger(req, 9.0, 8.1, 2000)


@query("""WITH p AS (SELECT user_id AS key, event_id AS seq, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS spent FROM events) SELECT * FROM p""")
def running_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9: the running sum that holds while nothing is blocked."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("value").alias("cost"))
    return ops.running_spend(e).select("key", "seq", F.round("spent", 2).alias("spent"))


@query("""WITH c AS (SELECT user_id AS key, event_id AS seq, ts AS seen, CAST(floor(value / 50) AS INT) AS priority, event_type AS value, event_id % 7 AS source FROM events),
h AS (SELECT c.*, (SELECT arg_min(struct_pack(v := d.value, s := d.source), (d.priority, -epoch_us(d.seen), d.seq)) FROM c d WHERE d.key = c.key AND (d.seen, d.seq) < (c.seen, c.seq)) AS held,
 (SELECT min(d.priority) FROM c d WHERE d.key = c.key AND (d.seen, d.seq) < (c.seen, c.seq)) AS p,
 (SELECT max(d.seen) FROM c d WHERE d.key = c.key AND (d.seen, d.seq) < (c.seen, c.seq) AND d.priority = (SELECT min(x.priority) FROM c x WHERE x.key = c.key AND (x.seen, x.seq) < (c.seen, c.seq))) AS at_time FROM c)
SELECT key, seq, (held IS NULL OR priority < p OR (priority = p AND seen > at_time)) AS applied, coalesce(held.s <> source AND held.v <> value, false) AS conflict FROM h""")
def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8 ST13 R9: which claims applied and which conflicted when they came."""
    e = table(spark, sf_dir, "events")
    claims = e.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.floor(F.col("value") / 50).cast("int").alias("priority"), F.col("event_type").alias("value"), (F.col("event_id") % 7).alias("source"))
    return ops.observe(claims).select("key", "seq", "applied", "conflict")


@query("""WITH p AS (SELECT o_orderkey AS id, (o_custkey % 10 + 1)::INT AS page, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 14)::INT END AS explicit, o_orderkey % 9 = 0 AS exhausted, (o_custkey % 60)::INT AS "offset" FROM orders)
SELECT id, CASE WHEN explicit IS NOT NULL THEN least(greatest(explicit, 1), 10) WHEN exhausted OR page >= 10 THEN 1 ELSE page + 1 END AS page, CASE WHEN explicit IS NULL AND (exhausted OR page >= 10) THEN 1 ELSE 0 END AS page_cycles,
CASE WHEN exhausted OR least(60, "offset" + 20) >= 60 OR least(60, "offset" + 20) >= 55 THEN 0 ELSE least(60, "offset" + 20) END AS link_offset FROM p""")
def checkpoint_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6 ST7 ST19 R6: pages and link windows move on and wrap."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    page = ops.advance_page((c % 10 + 1).cast("int"), F.when(k % 5 == 0, (k % 14).cast("int")), F.lit(10), k % 9 == 0)
    window = ops.advance_window((c % 60).cast("int"), F.lit(20), F.lit(60), F.lit(55), k % 9 == 0)
    return table(spark, sf_dir, "orders").select(k.alias("id"), page["page"].alias("page"), page["cycles"].alias("page_cycles"), window["offset"].alias("link_offset"))


_OLD = "old AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0)"
_NEW = "new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('n', c_name) END AS name, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS balance FROM customer WHERE c_custkey % 2 = 0)"


@query(f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL OR n.name IS NULL OR n.name = '' THEN o.name ELSE n.name END AS name, CASE WHEN n.id IS NULL OR n.segment IS NULL OR n.segment = '' THEN o.segment ELSE n.segment END AS segment,
CASE WHEN o.id IS NULL THEN n.balance WHEN n.id IS NULL THEN o.balance ELSE greatest(o.balance, n.balance) END AS balance, CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM old o FULL JOIN new n ON o.id = n.id""")
def field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK3 SK5 J5: an upsert that keeps fields, with counts by action."""
    old, new = _merge_inputs(spark, sf_dir)
    return ops.merge_rows(old, new, "id", {"balance": lambda o, n: F.greatest(o, n)})


def _merge_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = c.where(k % 3 != 0).select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("segment"), F.col("c_acctbal").alias("balance"))
    new = c.where(k % 2 == 0).select(k.alias("id"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("n"), "c_name")).alias("name"), F.col("c_mktsegment").alias("segment"), F.when(k % 2 == 0, F.col("c_acctbal") + 1).alias("balance"))
    return old, new


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK1: an upsert that replaces rows."""
    old, new = _merge_inputs(spark, sf_dir)
    return ops.replace_rows(old, new, "id")


@query("SELECT o_custkey AS key, min(o_orderkey) AS seq, arg_min(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY o_custkey")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK2 SK11: new keys only, the first row of each."""
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    return ops.insert_new(table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key")), new, "key")


@query(f"WITH {OPPORTUNITIES} SELECT source_url, id, confidence FROM opportunities QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY confidence DESC, id) = 1")
def legacy_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK4: one row per URL, the surest, the first on ties."""
    return ops.collapse(opportunities(spark, sf_dir, "source_url", "id", "confidence"), "source_url", F.col("confidence"), "id").select("source_url", "id", "confidence")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS decision, 1 + o_orderkey % 3 AS version FROM orders), r AS (SELECT o_orderkey AS id, 'approved' AS decision, 2 AS version FROM orders WHERE o_orderkey % 4 = 0)
SELECT o.id, CASE WHEN r.version = o.version THEN r.decision ELSE o.decision END AS decision, o.version + CASE WHEN r.version = o.version THEN 1 ELSE 0 END AS version, CASE WHEN r.version IS NULL THEN 'none' WHEN r.version = o.version THEN 'applied' ELSE 'stale' END AS outcome FROM o LEFT JOIN r USING (id)""")
def optimistic_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST15 SK7: a review applies only to the version it was written for."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("decision"), (1 + F.col("o_orderkey") % 3).alias("version"))
    return ops.apply_reviews(rows, o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id"), F.lit("approved").alias("decision"), F.lit(2).cast("bigint").alias("version")))


@query(f"WITH {OPPORTUNITIES} SELECT id, CASE WHEN review_decision = 'approved' THEN title ELSE upper(title) END AS title, CASE WHEN review_decision = 'approved' AND status IS DISTINCT FROM 'open' THEN 'pending' ELSE review_decision END AS review_decision FROM opportunities")
def protect_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST16: automated updates cannot change approved facts."""
    rows = opportunities(spark, sf_dir, "id", "title", "status", "review_decision")
    return ops.protect_approved(rows, rows.select("id", F.upper("title").alias("title"), F.lit("open").alias("status")), ["title"], "status")


@query("""WITH m AS (SELECT o_orderkey, o_totalprice / 100000 AS spend FROM orders) SELECT o_orderkey, CASE WHEN spend >= 5 THEN 'stopped' WHEN spend >= 4 THEN 'essential-only' WHEN spend >= 3 THEN 'conserve' ELSE 'normal' END AS mode,
CASE WHEN spend >= 4 THEN 0 WHEN spend >= 3 THEN 2 ELSE 8 END AS queries, CASE WHEN spend >= 4 THEN 1 WHEN spend >= 3 THEN 4 ELSE 10 END AS results, CASE WHEN spend >= 5 THEN 0 WHEN spend >= 4 THEN 4 WHEN spend >= 3 THEN 12 ELSE 40 END AS llm FROM m""")
def budget_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-10 R11: budget modes and what they leave."""
    mode = scoring.budget_mode(F.col("o_totalprice") / 100000, F.lit(3.0), F.lit(4.0), F.lit(5.0))
    left = scoring.limits(mode, F.lit(8), F.lit(10), F.lit(40))
    return table(spark, sf_dir, "orders").select("o_orderkey", mode.alias("mode"), left["queries"].alias("queries"), left["results"].alias("results"), left["llm"].alias("llm"))


@query("SELECT doc_id, round((n_chars * 0.045::DOUBLE + length(text) * 0.384::DOUBLE) / 1000000, 6) AS usd, strlen(text)::BIGINT AS bytes FROM documents")
def token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-11 TX30: cost of tokens, bounded by bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", scoring.token_cost(F.col("n_chars"), F.length("text")).alias("usd"), F.octet_length("text").cast("bigint").alias("bytes"))


@query("SELECT c_custkey, ('0x' || substring(sha256('bench-v1' || chr(31) || c_name), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 AS held FROM customer")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-12 E2: a hold-out by hash, whatever the order of rows."""
    return table(spark, sf_dir, "customer").select("c_custkey", scoring.held_out_by_hash(F.col("c_name"), "bench-v1").alias("held"))


@query("SELECT o_orderkey, sha256(concat_ws(chr(31), 'temporal:v1', o_orderkey::VARCHAR, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, ''), o_orderpriority)) AS idempotency_key FROM orders")
def idempotency_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JM8 R8: keys from joined parts."""
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.hash_parts(F.lit("temporal:v1"), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")), F.col("o_orderpriority")).alias("idempotency_key"))


@query(f"""WITH {OPPORTUNITIES}, {SOURCES} SELECT o.id, CASE WHEN s.source_family = 'opportunity-directory' THEN 80 WHEN o.source_type = 'social' THEN 300 WHEN o.source_type = 'community' THEN 250 WHEN o.source_type = 'press' THEN 180
WHEN NOT coalesce(regexp_replace(regexp_extract(o.official_url, '^https?://([^/]+)', 1), '^www\\.', '') = regexp_extract(o.source_url, '^https?://([^/]+)', 1), false) THEN 120 WHEN coalesce(o.application_url = o.source_url, false) THEN 10 ELSE 20 END AS priority
FROM opportunities o JOIN sources s ON s.id = o.id % 100""")
def claim_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strength of each claim."""
    from ..functions.url import host, path

    o = opportunities(spark, sf_dir, "id", "source_type", "source_url", "official_url", "application_url").join(sources(spark, sf_dir, "id", "source_family").withColumnRenamed("id", "sid"), F.col("id") % 100 == F.col("sid"))
    same = F.coalesce(host(F.col("official_url")) == host(F.col("source_url")), F.lit(False))
    return o.select("id", scoring.claim_priority(F.col("source_family"), F.col("source_type"), same, path(F.col("source_url")), F.coalesce(F.col("application_url") == F.col("source_url"), F.lit(False))).alias("priority"))
