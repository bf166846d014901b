"""The query registry, and views of the driver tables in the engine's own schemas.

``query`` registers a plan under its function's name together with the SQL that
states the same result. Views are lists of (name, expression) in the subset of
SQL that Spark and DuckDB share, so that both sides start from equal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}

#: The clock of all plans: functions take the time as a parameter.
NOW = "1998-06-15 10:20:00"


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(f: Plan) -> Plan:
        assert f.__name__ not in QUERIES, f.__name__
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores is dealt out over them, for work that is heavy for each row; large tables stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def moment(text: str) -> Column:
    """A time without zone as a literal, whatever the session's zone."""
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


#: Orders with their customers as opportunities.
OPPORTUNITY = [
    ("id", "o_orderkey"),
    ("slug", "concat('call-', cast(o_orderkey AS string))"),
    ("title", "concat(CASE o_orderkey % 9 WHEN 0 THEN 'The AI Film Festival ' WHEN 1 THEN 'Open Call ' WHEN 2 THEN 'Short Cuts Lab ' WHEN 3 THEN 'Late Deadline ' WHEN 4 THEN 'Residency at ' WHEN 5 THEN 'Grants and Competitions ' ELSE concat(c_mktsegment, ' Film Prize ') END, cast(1995 + o_orderkey % 7 AS string))"),
    ("organizer", "CASE WHEN o_orderkey % 17 = 0 THEN 'unknown organizer' ELSE c_name END"),
    ("summary", "concat('Call of ', c_mktsegment, ' for ', o_orderpriority)"),
    ("location", "CASE WHEN o_orderkey % 8 = 0 THEN 'Unspecified' ELSE concat('Nation ', cast(c_nationkey AS string)) END"),
    ("category", "CASE o_orderkey % 6 WHEN 0 THEN 'AI film festival' WHEN 1 THEN 'Traditional festival' WHEN 2 THEN 'Platform challenge' WHEN 3 THEN 'Grant' WHEN 4 THEN 'Residency' ELSE 'Advertising competition' END"),
    ("status", "CASE o_orderkey % 11 WHEN 0 THEN 'signal' WHEN 1 THEN 'discovered' WHEN 2 THEN 'closed' WHEN 3 THEN 'verified' WHEN 4 THEN 'verified' WHEN 5 THEN 'closing-soon' ELSE 'open' END"),
    ("ai_policy", "CASE o_orderkey % 5 WHEN 0 THEN 'required' WHEN 1 THEN 'allowed' WHEN 2 THEN 'restricted' ELSE 'unclear' END"),
    ("deadline", "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 45 DAY ELSE o_orderdate + INTERVAL 120 DAY END"),
    ("deadline_status", "CASE WHEN o_orderkey % 13 = 0 THEN 'rolling' WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 5 = 0 THEN 'estimated' ELSE 'confirmed' END"),
    ("opens_at", "CASE WHEN o_orderkey % 10 = 3 THEN o_orderdate + INTERVAL 30 DAY END"),
    ("prize_amount", "CASE WHEN o_orderkey % 4 = 0 THEN cast(floor(o_totalprice / 1000) AS double) END"),
    ("entry_fee_amount", "CASE o_orderkey % 3 WHEN 0 THEN cast(0 AS double) WHEN 1 THEN cast(25 AS double) END"),
    ("featured", "o_orderkey % 50 = 0"),
    ("discovered_at", "o_orderdate"),
    ("verified_at", "CASE WHEN o_orderkey % 4 <> 1 THEN o_orderdate + INTERVAL 3 DAY END"),
    ("source_url", "concat('https://site', cast(o_custkey % 97 AS string), '.example.org/calls/', cast(o_orderkey % 500 AS string))"),
    ("official_url", "CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 9 THEN concat('https://filmfreeway.com/fest', cast(o_orderkey AS string)) ELSE concat('https://www.site', cast(o_custkey % 97 AS string), '.example.org/') END"),
    ("application_url", "CASE WHEN o_orderkey % 6 = 1 THEN concat('https://festhome.com/f/', cast(o_orderkey AS string)) END"),
    ("source_url_status", "CASE o_orderkey % 8 WHEN 0 THEN 'invalid' WHEN 1 THEN 'unreachable' WHEN 2 THEN 'redirected' WHEN 3 THEN 'unchecked' ELSE 'verified' END"),
    ("official_url_status", "CASE o_orderkey % 7 WHEN 0 THEN 'unchecked' WHEN 1 THEN 'invalid' WHEN 2 THEN 'redirected' ELSE 'verified' END"),
    ("official_url_http_status", "CASE o_orderkey % 9 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 301 WHEN 3 THEN NULL ELSE 200 END"),
    ("source_type", "CASE o_orderkey % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'press' WHEN 2 THEN 'social' ELSE 'community' END"),
    ("confidence", "cast(o_orderkey % 100 AS double) / 100"),
    ("has_conflict", "o_orderkey % 23 = 0"),
    ("review_reason", "CASE WHEN o_orderkey % 19 = 0 THEN 'possible false-positive candidate' END"),
    ("review_required", "o_orderkey % 3 = 1"),
    ("review_decision", "CASE o_orderkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END"),
    ("readiness_score", "cast(o_custkey % 101 AS int)"),
    ("max_runtime_minutes", "CASE WHEN o_orderkey % 5 = 2 THEN 15 END"),
    ("eligibility", "CASE WHEN o_orderkey % 6 = 2 THEN 'open to all filmmakers' END"),
    ("tags", "CASE o_orderkey % 12 WHEN 2 THEN 'platform:festhome' WHEN 3 THEN 'festhome:77' WHEN 6 THEN 'short,animation' ELSE '' END"),
    ("previous_deadline", "CASE WHEN o_orderkey % 15 = 4 THEN o_orderdate + INTERVAL 30 DAY END"),
    ("previous_status", "CASE WHEN o_orderkey % 14 = 5 THEN 'open' WHEN o_orderkey % 14 = 6 THEN 'signal' END"),
    ("last_checked_at", "CASE WHEN o_orderkey % 5 <> 4 THEN o_orderdate + INTERVAL 10 DAY END"),
    ("edition_year", "cast(1995 + o_orderkey % 7 AS int)"),
    ("canonical_key", "concat(cast(o_custkey AS string), '-', cast(o_orderkey % 4 AS string))"),
]
OPPORTUNITIES = "opportunities AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in OPPORTUNITY) + " FROM orders JOIN customer ON o_custkey = c_custkey)"
#: Customers as registered sources.
SOURCE = [
    ("id", "c_custkey"),
    ("name", "c_name"),
    ("url", "concat('https://site', cast(c_custkey % 97 AS string), '.example.org/list/', cast(c_custkey AS string))"),
    ("priority", "cast(1 + c_custkey % 4 AS int)"),
    ("enabled", "c_custkey % 20 <> 7"),
    ("health_status", "CASE c_custkey % 15 WHEN 0 THEN 'blocked' WHEN 1 THEN 'paused' WHEN 2 THEN 'failing' WHEN 3 THEN 'degraded' ELSE 'healthy' END"),
    ("next_check_at", "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE TIMESTAMP '1998-06-01 00:00:00' + INTERVAL 1 DAY * cast(c_custkey % 30 AS int) END"),
    ("last_checked_at", "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE TIMESTAMP '1998-05-01 00:00:00' + INTERVAL 1 HOUR * cast(c_custkey % 900 AS int) END"),
    ("yield_score", "cast(c_custkey % 37 AS double) / 10"),
    ("poll_interval_minutes", "cast(360 + 720 * (c_custkey % 60) AS int)"),
    ("min_poll_interval_minutes", "360"),
    ("max_poll_interval_minutes", "43200"),
    ("consecutive_failures", "cast(c_custkey % 8 AS int)"),
    ("consecutive_no_change", "cast(c_custkey % 11 AS int)"),
    ("source_family", "CASE c_custkey % 5 WHEN 0 THEN 'official-site' WHEN 1 THEN 'opportunity-directory' WHEN 2 THEN 'film-funding' WHEN 3 THEN 'ai-creative-tech' ELSE 'structured-festival' END"),
    ("tier", "cast(1 + c_custkey % 3 AS int)"),
    ("country", "CASE WHEN c_custkey % 3 <> 0 THEN concat('country', cast(c_nationkey AS string)) END"),
]
SOURCES = "sources AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in SOURCE) + " FROM customer)"


def _ntz(expression: str) -> str:
    """Time literals without zone for Spark."""
    return expression.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")


def opportunities(spark: SparkSession, sf_dir: str, *columns: str, heavy: bool = False) -> DataFrame:
    """The view; ``heavy`` says that much is to be done with each row."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    orders = spread(orders) if heavy else orders
    both = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return both.select(*[F.expr(e).alias(n) for n, e in OPPORTUNITY if not columns or n in columns])


def sources(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(*[F.expr(_ntz(e)).alias(n) for n, e in SOURCE if not columns or n in columns])
