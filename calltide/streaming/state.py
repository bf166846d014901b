"""Streaming forms: windowed counts with watermarks, and the URL cache as keyed state.

Watermarks and event-time windows are an extension; the cache is the streaming form of the
batch operators of ``operators.state``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts per type and window; the same plan for a batch and, with ``late``, for a stream."""
    rows = events.withWatermark("ts", late) if late else events
    g = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def sliding_counts(events: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    g = events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def session_counts(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    g = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


CACHE = "url string, content_hash string, changes int, failures int, first_seen timestamp, last_seen timestamp, already_processed boolean"


def url_cache(observations: DataFrame) -> DataFrame:
    """The cache as a stream: (url, at, content_hash; null after a failure, 304 for not modified) in, the state after each batch out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        content, changes, failures, first, last = state.get if state.exists else (None, 0, 0, None, None)
        same = True
        for pdf in batches:
            for at, h in zip(pdf.sort_values("at")["at"], pdf.sort_values("at").content_hash, strict=True):
                first, last = first or int(at.value), int(at.value)
                if h is None or h != h:
                    failures += 1
                    continue
                failures = 0
                if h not in ("304", content):
                    content, changes, same = h, changes + 1, False
        state.update((content, changes, failures, first, last))
        yield pd.DataFrame([(key[0], content, changes, failures, pd.Timestamp(first), pd.Timestamp(last), same)], columns=[c.split()[0] for c in CACHE.split(", ")])

    schema = "content_hash string, changes int, failures int, first_seen bigint, last_seen bigint"
    return observations.groupBy("url").applyInPandasWithState(step, CACHE, schema, "update", GroupStateTimeout.NoTimeout)


def cache_from(spark: SparkSession, folder: str, schema: str, sink: str) -> None:
    """Runs the cache over the files of a folder that are there now (one micro-batch per file) into a memory table."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = url_cache(source).writeStream.outputMode("update").format("memory").queryName(sink).trigger(availableNow=True).start()
    q.awaitTermination()
