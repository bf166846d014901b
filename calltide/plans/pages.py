"""Queries on what single pages state."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..functions import pages as P
from ..operators import processing
from . import cases
from .base import moment, query, table


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


def _expected(names: str, rows: list[tuple[tuple, tuple]], typed: str) -> str:
    return f"WITH {cases.values(names, [want for _, want in rows])} SELECT c_custkey AS id, {typed} FROM customer JOIN cases ON c_custkey % {len(rows)} = k"


def _given(rows: list[tuple[tuple, tuple]]) -> list[tuple]:
    return [given for given, _ in rows]


@query(_expected("title, opening, closing, quote, status, funder, link", cases.GRANTS, "title, opening, closing, quote, status, funder, link"))
def grant_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT17: the facts of an Italian grant's page."""
    rows = cases.dealt(spark, _ids(spark, sf_dir), _given(cases.GRANTS), "t string, html string, label string, url string")
    links = F.when(F.col("url").isNotNull(), F.array(F.struct(F.col("url").alias("url"), F.col("label").alias("text"))))
    out = rows.select("id", P.grant_facts(F.col("t"), F.col("html"), links).alias("g")).select("id", "g.*")
    return out.select("id", "title", F.col("opening").cast("string").alias("opening"), F.col("closing").cast("string").alias("closing"), F.col("closing_quote").alias("quote"), "status", "funder", "link")


@query(_expected("own", cases.LEADS, "own"))
def lead_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that are a lead's own page or document."""
    rows = cases.dealt(spark, _ids(spark, sf_dir), _given(cases.LEADS), "name string, url string, title string")
    return rows.select("id", P.lead_call_page(F.col("name"), F.col("url"), F.col("title"), ["blocked.org"]).alias("own"))


def _links(joined: Column) -> Column:
    parts = F.filter(F.split(joined, " "), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.split(x, ">")[1].alias("url"), F.split(x, ">")[0].alias("text")))


@query(_expected("disposition, reason, title, organizer, category, application_url, remote, status", cases.EXTRACTIONS, "disposition, reason, title, organizer, category, application_url, remote::BOOLEAN AS remote, status"))
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opportunity that a page's visible content shows, or why it goes to a model."""
    rows = cases.dealt(spark, _ids(spark, sf_dir), _given(cases.EXTRACTIONS), "html string, t string, links string, deadline string")
    x = P.page_extraction(F.col("html"), F.col("t"), _links(F.col("links")), F.col("deadline").cast("date"))
    out = rows.select("id", x.alias("x"))
    return out.select("id", "x.disposition", "x.reason", *[F.col(f"x.record.{c}") for c in ("title", "organizer", "category", "application_url", "remote", "status")])


@query(_expected("deadline, status, method", cases.HUNTED, "deadline::VARCHAR AS deadline, status, method"))
def hunted_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X10 JB4: the best deadline of a page: dated, structured, or without its year."""
    rows = cases.dealt(spark, _ids(spark, sf_dir), _given(cases.HUNTED), "t string, closes string")
    rows = rows.withColumn("d", fields.decision_fields(date(2026, 3, 1))(F.col("t"), F.lit(None).cast("string")))
    best = P.best_deadline(F.col("d.deadline"), F.col("d.deadline_quote"), F.col("closes"), F.coalesce("t", F.lit("")), moment("2026-03-01 09:00:00"))
    out = rows.select("id", best.alias("b"))
    return out.select("id", F.col("b.deadline").cast("string").alias("deadline"), "b.status", "b.method")


_PROCESSED = "source, code, title, organizer, category, deadline, deadline_status, fee, currency, max_minutes, ai_policy, official_url"


@query(_expected(_PROCESSED, cases.PROCESSED, _PROCESSED.replace("fee,", "fee::DOUBLE AS fee,").replace("max_minutes", "max_minutes::INT AS max_minutes").replace("deadline,", "deadline::VARCHAR AS deadline,", 1)))
def processed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X28 JB2 JB5: pages through the cascade of items, facts, normalisation and rejects."""
    rows = cases.dealt(spark, _ids(spark, sf_dir), _given(cases.PROCESSED), "html string, text string, title string, joined string, preset string, answer string")
    fetched = rows.select(F.col("id").alias("page_id"), F.lit("https://h.org/call").alias("url"), "html", "text", "title", _links(F.col("joined")).alias("links"), "preset", "answer")
    out = processing.process(fetched, date(2026, 3, 1), moment("2026-03-01 09:00:00"))
    return out.withColumn("deadline", F.col("deadline").cast("string")).select(F.col("page_id").alias("id"), *_PROCESSED.split(", "))
