"""Sinks: partition overwrite, run log, text outputs, requeue and seed upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Children of the keys in ``rows`` are replaced, those of other keys stay (one write, dynamic partitions)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_run(run: DataFrame, path: str) -> None:
    """The run log is append-only."""
    run.write.mode("append").parquet(path)


def provenance(records: DataFrame, run_id: str) -> DataFrame:
    """A row per record and hit with an idempotency key out of its parts."""
    from ..functions.scoring import hash_parts

    each = records.select("id", F.explode("provenance").alias("p"))
    key = hash_parts(F.lit(run_id), F.col("id"), F.col("p.provider"), F.col("p.query_id"), F.col("p.source_url"), F.col("p.rank"))
    return each.select("id", "p.*", key.alias("idempotency_key"))


def brief_text(items: DataFrame) -> DataFrame:
    """Sections of a brief as text, lines in the order of their positions."""
    line = F.concat(F.lit("- "), "title")
    rows = items.groupBy("section").agg(F.min("position").alias("first"), F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("l"))  # at most 16 rows in all
    return rows.select("section", F.concat(F.upper("section"), F.lit("\n"), F.array_join("l.line", "\n")).alias("text"))


def sitemap(rows: DataFrame, base: str) -> DataFrame:
    """The entries of a sitemap, one row each."""
    return rows.select(F.concat(F.lit(f"<url><loc>{base}/"), "slug", F.lit("</loc><lastmod>"), F.date_format("lastmod", "yyyy-MM-dd"), F.lit("</lastmod></url>")).alias("entry"))


def requeue(cache: DataFrame, sources: DataFrame, family: str, versions: list[str], before: Column) -> DataFrame:
    """Pages of a family that given processor versions settled before a time lose their processed hash."""
    of = sources.where(F.col("source_family") == family).select("source_id").distinct().withColumn("hit", F.lit(True))
    both = cache.join(of, "source_id", "left")
    again = F.coalesce(F.col("hit"), F.lit(False)) & F.col("processor").isin(versions) & (F.col("processed_at") < before)
    return both.withColumn("processed_hash", F.when(again, None).otherwise(F.col("processed_hash"))).drop("hit")


def seed(existing: DataFrame, catalogue: DataFrame, key: str, retired: list[str]) -> DataFrame:
    """The catalogue's rows replace those of their keys; retired URLs are disabled."""
    out = existing.join(catalogue.select(key), key, "left_anti").unionByName(catalogue)
    return out.withColumn("enabled", F.col("enabled") & ~F.col(key).isin(retired))


def page_provenance(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """(canonical_key, provenance) of stored rows (canonical_key, source_url) whose page was met again unchanged.

    ``pages``: input_url, final_url and the provenance (an array of entries) of the candidate that led there; a page counts under both URLs.
    """
    from ..functions.url import canonical

    each = pages.select(F.explode(F.array_distinct(F.filter(F.array(canonical(F.col("input_url")), canonical(F.col("final_url"))), lambda u: u.isNotNull()))).alias("url"), "provenance")
    entries = each.select("url", F.explode("provenance").alias("p"))
    known = stored.select("canonical_key", canonical(F.col("source_url")).alias("url"))
    return known.join(entries, "url").groupBy("canonical_key", "url").agg(F.array_sort(F.collect_set("p")).alias("provenance"))


def store_json(rows: DataFrame, path: str) -> None:
    """The rows as JSON lines in a folder of the store; an earlier report there is replaced."""
    rows.write.mode("overwrite").json(path)
