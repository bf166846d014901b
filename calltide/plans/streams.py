"""Streaming queries in their batch form (an extension), with SQL of equal results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming import state as ops
from .base import query, table


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts and sums by type."""
    return ops.tumbling_counts(table(spark, sf_dir, "events"))


@query("""WITH d AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM d GROUP BY 1""")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two days, each day."""
    return ops.sliding_counts(table(spark, sf_dir, "events"))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM l) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a gap of six hours."""
    return ops.session_counts(table(spark, sf_dir, "events"))
