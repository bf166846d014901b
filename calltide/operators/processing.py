"""Fetched pages to records: preset items, else visible content, else a model's answer; then facts, normalisation and rejects."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields, pages
from ..functions import html as H
from ..functions import records as R
from ..functions.text import bound

ITEM = "title: string, organizer: string, category: string, deadline: string, fee: string, currency: string, official: string"


def process(fetched: DataFrame, today: date, now: Column) -> DataFrame:
    """(page_id, source, code, title, organizer, category, deadline, deadline_status, fee, currency, max_minutes, ai_policy, official_url): a row per item, or per page that gives none.

    ``fetched``: page_id, url, html, text, title, links (an array of (url, text)), preset and answer (JSON arrays of items, or null).
    Preset items come first; else what the visible content shows clearly; else the model's answer; a page without any of them is left
    with the code of why. Facts of the page fill in what the item of a page with one item lacks; items are normalised and grounded in their page.
    """
    c = F.col
    items = f"array<struct<{ITEM}>>"
    read = fetched.withColumn("facts", fields.decision_fields(today)(c("text"), c("title")))
    best = pages.best_deadline(c("facts.deadline"), c("facts.deadline_quote"), H.json_ld_event(c("html"))["closes"], c("text"), now)
    read = read.withColumn("best", best)
    read = read.withColumn("shown", pages.page_extraction(c("html"), c("text"), c("links"), c("best.deadline")))
    visible = F.when(c("shown.disposition") == "complete", F.array(F.struct(
        c("shown.record.title").alias("title"), c("shown.record.organizer").alias("organizer"), c("shown.record.category").alias("category"), F.lit(None).cast("string").alias("deadline"), F.lit(None).cast("string").alias("fee"),
        F.lit(None).cast("string").alias("currency"), c("url").alias("official"))))
    preset, answer = F.from_json("preset", items), F.from_json("answer", items)
    source = F.when(preset.isNotNull(), "preset").when(visible.isNotNull(), "visible").when(answer.isNotNull(), "model").otherwise("none")
    read = read.withColumns({"source": source, "items": F.coalesce(preset, visible, answer, F.array().cast(items))})
    read = read.withColumns({"single": F.size("items") == 1, "page_title": F.coalesce("title", F.lit("")), "page": c("text"), "links": F.transform("links", lambda x: x["url"])})
    each = read.select("page_id", "url", "source", "single", "page_title", "page", "links", "facts", "best", "shown", F.explode_outer("items").alias("item"))
    one = lambda own, fact: F.coalesce(own, F.when(c("single"), fact))
    each = each.select("*", "item.title", "item.organizer", "item.category", "item.deadline", "item.currency", "item.official", c("item.fee").alias("fee")).withColumns({"fee": one(c("fee"), c("facts.fee").cast("string")), "currency": one(c("currency"), c("facts.fee_currency"))})

    def settled(n: Column) -> Column:
        dated = F.coalesce(F.to_date(n["record"]["deadline"]), F.when(c("single"), c("best.deadline")))
        status = F.when(n["record"]["deadline"].isNotNull(), n["record"]["deadline_status"]).when(dated.isNotNull(), c("best.status")).otherwise("unknown")
        return F.struct(n["code"].alias("code"), n["record"].alias("record"), dated.alias("deadline"), status.alias("status"))

    out = each.withColumn("n", bound(R.normalized(now), settled))
    code = F.when(c("item").isNull(), F.when(c("source") == "none", F.coalesce(c("shown.reason"), F.lit("NO_ANSWER"))).otherwise("NOT_RELEVANT")).when(c("n.code").isNotNull(), c("n.code")).when(c("n.deadline") < F.to_date(now), "DEADLINE_PASSED")
    kept = lambda x: F.when(code.isNull(), x)
    return out.select(
        "page_id", "source", code.alias("code"), *[kept(c(f"n.record.{k}")).alias(k) for k in ("title", "organizer", "category")], kept(c("n.deadline")).alias("deadline"), kept(c("n.status")).alias("deadline_status"), kept(c("n.record.fee")).alias("fee"),
        kept(c("n.record.currency")).alias("currency"), kept(F.when(c("single"), c("facts.max_minutes"))).alias("max_minutes"), kept(F.when(c("single"), c("facts.ai_policy"))).alias("ai_policy"), kept(c("n.record.official_url")).alias("official_url"))
