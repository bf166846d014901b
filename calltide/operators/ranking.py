"""Ranked selections: due sources, fair admission, briefs, query rotation, keepers.

Global tops use ``orderBy().limit()``, which keeps k rows per task; tops per
key use ``row_number`` with a unique tie-break, so results do not depend on the
order of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def numbered(rows: DataFrame, order: list[Column], k: int, rank: str = "position", start: int = 0) -> DataFrame:
    """The first k rows with their places; the window runs over k rows only."""
    return rows.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)) - 1 + start)


def is_due(now: Column) -> Column:
    return F.col("enabled") & ~F.col("health_status").isin("blocked", "paused") & (F.col("next_check_at").isNull() | (F.col("next_check_at") <= now))


def select_due(sources: DataFrame, now: Column, limit: int) -> DataFrame:
    """Due sources: a reserve of floor(0.3 limit) for those of priority 1 and 2 comes first, then the rest in due order."""
    order = [F.asc_nulls_first("next_check_at"), F.asc("priority"), F.asc_nulls_first("last_checked_at"), F.desc("yield_score"), F.asc("id")]
    due = sources.where(is_due(now))
    reserve = int(limit * 0.3)
    kept = numbered(due.where("priority < 3"), [F.asc("priority"), *order], reserve)
    rest = due.join(F.broadcast(kept.select("id")), "id", "left_anti").orderBy(*order).limit(limit)  # at most ``reserve`` rows
    n = kept.agg(F.count("*").alias("n"))
    rest = rest.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1).crossJoin(F.broadcast(n))
    rest = rest.withColumn("position", F.col("place") + F.col("n").cast("int")).where(F.col("position") < limit)
    return kept.unionByName(rest.drop("place", "n"))


def monitor_candidates(sources: DataFrame, now: Column, overdue: int, important: int) -> DataFrame:
    """Overdue sources and the most important ones, once each."""
    due = sources.where(is_due(now))
    a = due.orderBy(F.asc_nulls_first("next_check_at"), "id").limit(overdue)
    b = due.where("priority < 3").orderBy("priority", "id").limit(important)
    return a.unionByName(b).dropDuplicates(["id"])


def admit(hits: DataFrame, limit: int, per_host: int = 3) -> DataFrame:
    """Fair admission of search hits (rank, query_no, url, host): round robin over queries by rank, each URL once, ``per_host`` of a host, ``limit`` in all.

    A URL stands where it is first met. Within its host the first
    ``per_host`` distinct URLs can be admitted, whatever the limit, so both
    caps are windows over distinct URLs, not a fold; all queries of a URL stay
    its provenance, also those met after the limit.
    """
    urls = hits.groupBy("url", "host").agg(F.min(F.struct("rank", "query_no")).alias("first"), F.array_sort(F.collect_set(F.struct("rank", "query_no"))).alias("provenance"))
    urls = urls.withColumn("host_no", F.row_number().over(Window.partitionBy("host").orderBy("first", "url"))).where(F.col("host_no") <= per_host)
    return numbered(urls, [F.asc("first"), F.asc("url")], limit)


def keepers(rows: DataFrame, key: str) -> DataFrame:
    """The duplicate of each key to keep: approved, then dated, then verified, then sure; the first of equals."""
    rank = F.when(F.col("review_decision") == "approved", 100).otherwise(0) + F.when(F.col("deadline").isNotNull(), 10).otherwise(0) + F.when(F.col("status") == "verified", 5).otherwise(0) + F.col("confidence")
    return top_per(rows.withColumn("score", rank), [key], [F.desc("score"), F.asc("id")], 1).drop("rank")


def title_keepers(rows: DataFrame, key: str) -> DataFrame:
    """Of published duplicates: a title without a label first, then the longest, then the lowest id."""
    labelled = F.lower("title").rlike("^(?:open call|late deadline|call for)")
    return top_per(rows, [key], [F.when(labelled, 1).otherwise(0).asc(), F.length("title").desc(), F.asc("id")], 1).drop("rank")


def ambiguous_leads(pairs: DataFrame, key: str, gap: float = 0.006) -> DataFrame:
    """Keys whose two best pairs have the same method and confidences within ``gap``."""
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), F.asc("other"))
    out = pairs.withColumn("next_confidence", F.lead("confidence").over(w)).withColumn("next_method", F.lead("method").over(w)).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    unclear = (F.col("next_method") == F.col("method")) & (F.round(F.col("confidence") - F.col("next_confidence"), 9) <= gap)
    return out.select(key, "other", "confidence", F.coalesce(unclear, F.lit(False)).alias("ambiguous"))


def brief_sections(rows: DataFrame, now: Column) -> DataFrame:
    """A weekly brief: closing soon 5, new and valuable 5, changed 3, watched AI calls 3; a call stands in one section only."""
    from ..functions.scoring import days_between, value_score

    rolling = F.col("deadline_status") == "rolling"
    days = days_between(F.col("deadline"), now)
    live = rows.where(rolling | F.col("deadline").isNull() | (F.col("deadline") >= now)).withColumns({"value": value_score(now), "days": days})
    ai = (F.col("category") == "AI film festival") | F.col("ai_policy").isin("allowed", "required")
    changed = (F.col("previous_deadline").isNotNull() & ~F.col("previous_deadline").eqNullSafe(F.col("deadline"))) | (
        F.col("previous_status").isNotNull() & (F.col("previous_status") != F.col("status")) & ~F.col("previous_status").isin("signal", "discovered"))
    recent = days_between(now, F.col("verified_at"))
    steps = [
        ("action_now", ~rolling & (days <= 30), [F.asc("deadline"), F.asc("id")], 5, F.greatest(F.lit(1), F.lit(30) - F.ceil("days")).cast("int")),
        ("new_high_value", (recent >= 0) & (recent <= 7), [F.desc("value"), F.asc_nulls_last("deadline"), F.asc("id")], 5, F.col("value")),
        ("changed", changed, [F.asc_nulls_last("deadline"), F.asc("id")], 3, F.lit(2)),
        ("watch", ai, [F.desc_nulls_last("readiness_score"), F.asc("id")], 3, F.lit(1)),
    ]
    out = None
    for i, (section, condition, order, k, priority) in enumerate(steps):
        left = live.where(F.coalesce(condition, F.lit(False)))
        if out is not None:
            left = left.join(F.broadcast(out.select("id")), "id", "left_anti")  # at most 16 rows
        part = numbered(left, order, k, "place").select(F.lit(i).alias("section_no"), F.lit(section).alias("section"), "place", "id", "title", priority.alias("priority"))
        out = part if out is None else out.unionByName(part)
    position = F.row_number().over(Window.orderBy("section_no", "place")) - 1
    return out.select("section", position.alias("position"), "id", "title", "priority")


def choose_queries(queries: DataFrame, score: Column, n: int, share: float) -> DataFrame:
    """Exploration first (fewest runs), then the best scores; ``share`` is kept between 0.15 and 0.5."""
    explore = min(n, max(1, -int(-n * min(max(share, 0.15), 0.5) // 1)))
    scored = queries.withColumn("score", score)
    a = numbered(scored, [F.asc("runs"), F.desc("score"), F.asc("id")], explore).withColumn("how", F.lit("explore"))
    rest = scored.join(F.broadcast(a.select("id")), "id", "left_anti")
    b = numbered(rest, [F.desc("score"), F.asc("id")], n - explore, start=explore).withColumn("how", F.lit("score"))
    return a.unionByName(b)


def rotation(items: DataFrame, index: str, n: int, slot: int, take: int) -> DataFrame:
    """``take`` of n items from a place that moves on with the slot, in order of the rotation."""
    place = F.pmod(F.col(index) - F.lit(slot * take), F.lit(n))
    return items.withColumn("place", place).where(F.col("place") < take)


def link_scores(links: DataFrame, positive: list[str], negative: list[str], strong: list[str], year: int) -> DataFrame:
    """Scores links (page_id, position, url, text, page_host): a point per positive pattern, two for the years, one for the own host, ten less for negative ones."""
    hay = F.concat_ws(" ", "url", F.coalesce("text", F.lit("")))
    score = sum((F.when(hay.rlike(p), 1).otherwise(0) for p in positive), F.lit(0))
    from ..functions.url import raw_host

    score = score + F.when(hay.contains(str(year)) | hay.contains(str(year + 1)), 2).otherwise(0) + F.when(raw_host(F.col("url")) == F.col("page_host"), 1).otherwise(0)
    bad, good = (F.lit(False), F.lit(False))
    for p in negative:
        bad |= hay.rlike(p)
    for p in strong:
        good |= hay.rlike(p)
    return links.withColumn("score", score - F.when(bad, 10).otherwise(0)).withColumn("strong", good).where("score > 0 and strong")


def window_of(rows: DataFrame, keys: list[str], order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of each key."""
    return top_per(rows, keys, order, offset + limit).where(F.col("rank") > offset)
