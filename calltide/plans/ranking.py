"""Ranking, window and top-k queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import catalogue as cat
from ..operators import graph
from ..operators import ranking as ops
from .base import NOW, OPPORTUNITIES, SOURCES, moment, opportunities, query, sources, table

_DUE = f"enabled AND health_status NOT IN ('blocked','paused') AND (next_check_at IS NULL OR next_check_at <= TIMESTAMP '{NOW}')"
_ORDER = "next_check_at ASC NULLS FIRST, priority, last_checked_at ASC NULLS FIRST, yield_score DESC, id"


@query(f"""WITH {SOURCES}, d AS (SELECT * FROM sources WHERE {_DUE}), r AS (SELECT *, row_number() OVER (ORDER BY priority, {_ORDER}) - 1 AS position FROM d WHERE priority < 3 QUALIFY position < 15),
x AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 + (SELECT count(*) FROM r) AS position FROM d WHERE id NOT IN (SELECT id FROM r))
SELECT id, priority, position::INT AS position FROM r UNION ALL SELECT id, priority, position::INT FROM x WHERE position < 50""")
def due_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty due sources with a reserve for the important ones."""
    return ops.select_due(sources(spark, sf_dir), moment(NOW), 50).select("id", "priority", "position")


@query(f"""WITH {SOURCES}, d AS (SELECT * FROM sources WHERE {_DUE}) (SELECT id FROM d ORDER BY next_check_at ASC NULLS FIRST, id LIMIT 70) UNION (SELECT id FROM d WHERE priority < 3 ORDER BY priority, id LIMIT 20)""")
def monitor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overdue and important sources, once each."""
    return ops.monitor_candidates(sources(spark, sf_dir), moment(NOW), 70, 20).select("id")


@query(f"""WITH {SOURCES} SELECT id FROM sources WHERE NOT (regexp_extract(url, '^https?://([^/]+)', 1) IN ('site3.example.org','site5.example.org') AND coalesce(last_checked_at >= TIMESTAMP '{NOW}' - INTERVAL 28 DAY, false))""")
def weekly_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hosts that are read once a period only."""
    from ..functions.url import host, host_in

    recent = F.coalesce(F.col("last_checked_at") >= moment(NOW) - F.expr("INTERVAL 28 DAY"), F.lit(False))
    return sources(spark, sf_dir, "id", "url", "last_checked_at").where(~(host_in(host(F.col("url")), ["site3.example.org", "site5.example.org"]) & recent)).select("id")


@query(f"WITH {SOURCES} SELECT id, (row_number() OVER (ORDER BY last_checked_at ASC NULLS FIRST, id) - 1)::INT AS position FROM sources QUALIFY position < 40")
def stalest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Never checked first, then the longest ago."""
    return ops.numbered(sources(spark, sf_dir, "id", "last_checked_at"), [F.asc_nulls_first("last_checked_at"), F.asc("id")], 40).select("id", "position")


@query(f"""WITH {SOURCES}, f AS (SELECT *, row_number() OVER (PARTITION BY tier, country ORDER BY last_checked_at ASC NULLS FIRST, priority, url) AS rn FROM sources WHERE country IS NOT NULL)
SELECT id, (row_number() OVER (ORDER BY last_checked_at ASC NULLS FIRST, priority, url) - 1)::INT AS position FROM f WHERE rn = 1 QUALIFY position < 30""")
def historical_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W15 SC27: one item per queue, then the longest ago."""
    order = [F.asc_nulls_first("last_checked_at"), F.asc("priority"), F.asc("url")]
    first = ops.top_per(sources(spark, sf_dir).where("country is not null"), ["tier", "country"], order, 1)
    return ops.numbered(first, order, 30).select("id", "position")


@query("""WITH h AS (SELECT l_linenumber AS rank, l_suppkey AS query_no, concat('https://h', (l_partkey % 60)::VARCHAR, '.example.org/', (l_partkey % 300)::VARCHAR) AS url, concat('h', (l_partkey % 60)::VARCHAR, '.example.org') AS host FROM lineitem),
u AS (SELECT url, host, min(rank * 1000000 + query_no) AS first, count(DISTINCT rank * 1000000 + query_no) AS hits FROM h GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY first, url) AS host_no FROM u)
SELECT url, hits, (row_number() OVER (ORDER BY first, url) - 1)::INT AS position FROM n WHERE host_no <= 3 QUALIFY position < 100""")
def fair_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round-robin admission with a cap per host and in all."""
    p = F.col("l_partkey")
    hits = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("rank"), F.col("l_suppkey").alias("query_no"), F.concat(F.lit("https://h"), (p % 60).cast("string"), F.lit(".example.org/"), (p % 300).cast("string")).alias("url"),
        F.concat(F.lit("h"), (p % 60).cast("string"), F.lit(".example.org")).alias("host"))
    return ops.admit(hits, 100).select("url", F.size("provenance").cast("bigint").alias("hits"), "position")


@query(f"""WITH {OPPORTUNITIES}, s AS (SELECT *, CASE WHEN review_decision = 'approved' THEN 100 ELSE 0 END + CASE WHEN deadline IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN status = 'verified' THEN 5 ELSE 0 END + confidence AS score FROM opportunities)
SELECT canonical_key, id FROM s QUALIFY row_number() OVER (PARTITION BY canonical_key ORDER BY score DESC, id) = 1""")
def duplicate_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which duplicate stays."""
    return ops.keepers(opportunities(spark, sf_dir, "id", "canonical_key", "review_decision", "deadline", "status", "confidence"), "canonical_key").select("canonical_key", "id")


@query(f"""WITH {OPPORTUNITIES} SELECT canonical_key, id, title FROM opportunities WHERE review_decision = 'approved' QUALIFY row_number() OVER (PARTITION BY canonical_key ORDER BY CASE WHEN regexp_matches(lower(title), '^(?:open call|late deadline|call for)') THEN 1 ELSE 0 END, length(title) DESC, id) = 1""")
def published_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which published duplicate stays."""
    return ops.title_keepers(opportunities(spark, sf_dir, "id", "canonical_key", "title", "review_decision").where("review_decision = 'approved'"), "canonical_key").select("canonical_key", "id", "title")


@query("""WITH p AS (SELECT l_orderkey AS record, l_partkey AS other, l_suppkey % 3 AS method, round(1 - l_discount / 10 - l_tax / 10, 6) AS confidence, l_linenumber FROM lineitem), u AS (SELECT record, other, max(method) AS method, max(confidence) AS confidence FROM p GROUP BY 1, 2),
w AS (SELECT *, lead(confidence) OVER x AS nc, lead(method) OVER x AS nm, row_number() OVER x AS rn FROM u WINDOW x AS (PARTITION BY record ORDER BY confidence DESC, other))
SELECT record, other, confidence, coalesce(nm = method AND round(confidence - nc, 9) <= 0.006, false) AS ambiguous FROM w WHERE rn = 1""")
def ambiguous_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose best two candidates are too close."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_partkey").alias("other"), (F.col("l_suppkey") % 3).alias("method"), F.round(1 - F.col("l_discount") / 10 - F.col("l_tax") / 10, 6).alias("confidence"))
    return ops.ambiguous_leads(p.groupBy("record", "other").agg(F.max("method").alias("method"), F.max("confidence").alias("confidence")), "record")


_DAYS = f"(epoch_us(deadline) - epoch_us(TIMESTAMP '{NOW}')) / 86400000000.0::DOUBLE"
_VALUE = f"(CASE WHEN category = 'AI film festival' OR ai_policy IN ('allowed','required') THEN 3 ELSE 0 END + CASE WHEN prize_amount > 0 THEN 2 ELSE 0 END + CASE WHEN entry_fee_amount = 0 THEN 1 ELSE 0 END + CASE WHEN {_DAYS} BETWEEN 0 AND 30 THEN 1 ELSE 0 END)"


@query(f"""WITH {OPPORTUNITIES}, live AS (SELECT *, {_DAYS} AS days, {_VALUE} AS val FROM opportunities WHERE (deadline_status = 'rolling' OR deadline IS NULL OR deadline >= TIMESTAMP '{NOW}')),
a AS (SELECT 0 AS s, 'action_now' AS section, id, title, greatest(1, 30 - ceil(days))::INT AS priority, row_number() OVER (ORDER BY deadline, id) AS place FROM live WHERE deadline_status <> 'rolling' AND days <= 30 QUALIFY place <= 5),
b AS (SELECT 1, 'new_high_value', id, title, val::INT, row_number() OVER (ORDER BY val DESC, deadline ASC NULLS LAST, id) AS place FROM live WHERE verified_at <= TIMESTAMP '{NOW}' AND verified_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND id NOT IN (SELECT id FROM a) QUALIFY place <= 5),
c AS (SELECT 2, 'changed', id, title, 2, row_number() OVER (ORDER BY deadline ASC NULLS LAST, id) AS place FROM live WHERE ((previous_deadline IS NOT NULL AND previous_deadline IS DISTINCT FROM deadline) OR (previous_status IS NOT NULL AND previous_status <> status AND previous_status NOT IN ('signal','discovered')))
  AND id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b) QUALIFY place <= 3),
d AS (SELECT 3, 'watch', id, title, 1, row_number() OVER (ORDER BY readiness_score DESC NULLS LAST, id) AS place FROM live WHERE (category = 'AI film festival' OR ai_policy IN ('allowed','required')) AND id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b) AND id NOT IN (SELECT id FROM c) QUALIFY place <= 3),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d)
SELECT section, (row_number() OVER (ORDER BY s, place) - 1)::INT AS position, id, title, priority FROM u""")
def brief_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W20 M-4 R20 JB8: the weekly brief."""
    return ops.brief_sections(opportunities(spark, sf_dir), moment(NOW))


@query(f"""WITH {OPPORTUNITIES}, q AS (SELECT *, epoch_us(discovered_at) AS d FROM opportunities WHERE deadline IS NULL OR deadline_status = 'unknown')
SELECT id, (row_number() OVER (ORDER BY CASE WHEN category = 'AI film festival' OR ai_policy IN ('allowed','required') THEN 1 ELSE 0 END DESC, readiness_score DESC, discovered_at DESC, id) - 1)::INT AS position FROM q QUALIFY position < 60""")
def hunt_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AI calls first, then the readiest, then the newest."""
    rows = opportunities(spark, sf_dir, "id", "deadline", "deadline_status", "category", "ai_policy", "readiness_score", "discovered_at").where("deadline is null or deadline_status = 'unknown'")
    return ops.numbered(rows, [F.when(cat.ai_related(), 1).otherwise(0).desc(), F.desc("readiness_score"), F.desc("discovered_at"), F.asc("id")], 60).select("id", "position")


@query(f"""WITH {OPPORTUNITIES} SELECT id, row_number() OVER (ORDER BY CASE WHEN category = 'AI film festival' OR ai_policy IN ('allowed','required') THEN 0 ELSE 1 END, deadline ASC NULLS LAST, id)::INT AS place FROM opportunities WHERE review_decision = 'pending' QUALIFY place <= 25""")
def approval_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals under a cap, AI calls first, then what closes first."""
    rows = opportunities(spark, sf_dir, "id", "category", "ai_policy", "deadline", "review_decision").where("review_decision = 'pending'")
    return ops.numbered(rows, [F.when(cat.ai_related(), 0).otherwise(1).asc(), F.asc_nulls_last("deadline"), F.asc("id")], 25, "place", 1).select("id", "place")


_QUERIES = "q AS (SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS high, s_nationkey AS validated, s_suppkey % 50 AS candidates, s_suppkey % 4 AS new_sources, s_suppkey % 6 AS runs, (s_suppkey % 5) / 10.0::DOUBLE AS gap, abs(s_acctbal) / 1000 AS cost FROM supplier)"
_SCORE = "CASE WHEN high THEN 2.0::DOUBLE ELSE 0 END + 5.0::DOUBLE * validated / greatest(1, candidates) + 3.0::DOUBLE * new_sources / greatest(1, runs) + 4 * gap + 2 / sqrt(runs + 1) - least(4, 20 * cost / greatest(1, validated + new_sources)) + ((7 + 17 * id) % 101) / 10000.0::DOUBLE"


@query(f"""WITH {_QUERIES}, s AS (SELECT *, {_SCORE} AS score FROM q), a AS (SELECT id, score, (row_number() OVER (ORDER BY runs, score DESC, id) - 1)::INT AS position, 'explore' AS how FROM s QUALIFY position < 4),
b AS (SELECT id, score, (row_number() OVER (ORDER BY score DESC, id) - 1 + 4)::INT AS position, 'score' AS how FROM s WHERE id NOT IN (SELECT id FROM a) QUALIFY position < 10)
SELECT id, round(score, 6) AS score, position, how FROM a UNION ALL SELECT id, round(score, 6), position, how FROM b""")
def adaptive_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W21 M-5 R13: queries by exploration and adaptive score."""
    k = F.col("s_suppkey")
    q = table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 2 == 0).alias("high"), F.col("s_nationkey").alias("validated"), (k % 50).alias("candidates"), (k % 4).alias("new_sources"), (k % 6).alias("runs"), ((k % 5) / 10.0).alias("gap"), (F.abs("s_acctbal") / 1000).alias("cost"))
    c = F.col
    score = scoring.query_score(c("high"), c("validated"), c("candidates"), c("new_sources"), c("runs"), c("gap"), c("cost"), 7, c("id"))
    return ops.choose_queries(q, score, 10, 0.4).select("id", F.round("score", 6).alias("score"), "position", "how")


@query("WITH p AS (SELECT s_suppkey AS id, ((s_suppkey - 3 * 8) % 10 + 10) % 10 AS place FROM supplier WHERE s_suppkey < 10) SELECT id, place FROM p WHERE place < 8")
def rotation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rotating share of a fixed list of ten (the list is the plan's size)."""
    return ops.rotation(table(spark, sf_dir, "supplier").where("s_suppkey < 10").select(F.col("s_suppkey").alias("id")), "id", 10, 3, 8)


@query("SELECT l_orderkey, l_partkey, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rn FROM lineitem) WHERE rn > 2 AND rn <= 4")
def checkpoint_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of ranked links that starts at an offset."""
    return ops.window_of(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_linenumber")], 2, 2).select("l_orderkey", "l_partkey", "rank")


@query(f"WITH {OPPORTUNITIES} SELECT id, coalesce(application_url, official_url, source_url) AS link FROM opportunities")
def first_defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value that there is."""
    return opportunities(spark, sf_dir, "id", "application_url", "official_url", "source_url").select("id", F.coalesce("application_url", "official_url", "source_url").alias("link"))


@query(f"WITH {OPPORTUNITIES} SELECT id, readiness_score FROM opportunities WHERE review_decision = 'pending' ORDER BY readiness_score DESC, id LIMIT 10")
def triage_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten readiest."""
    return opportunities(spark, sf_dir, "id", "readiness_score", "review_decision").where("review_decision = 'pending'").orderBy(F.desc("readiness_score"), "id").limit(10).select("id", "readiness_score")


@query("""WITH p AS (SELECT l_orderkey % 100 AS g, l_orderkey AS a, l_partkey AS b, max(1 - l_discount) AS confidence, max(l_linenumber) AS m FROM lineitem GROUP BY 1, 2, 3)
SELECT g, count(*) > 0 AS some FROM p GROUP BY g""")
def matching_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-8 (greedy step): every group of candidate pairs gets an assignment."""
    p = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("g"), F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.max(1 - F.col("l_discount")).alias("confidence"), F.max("l_linenumber").alias("method_no"))
    p = p.withColumns({"down": -F.col("confidence"), "method_down": -F.col("method_no")})
    return graph.assign(p, ["g", "a"], ["g", "b"], ["down", "method_down"]).groupBy("g").agg((F.count("*") > 0).alias("some"))


