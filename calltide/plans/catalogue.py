"""Catalogue queries over opportunities (orders with their customers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue as ops
from ..operators.catalogue import Options
from .base import NOW, OPPORTUNITIES, moment, opportunities, query

_LISTED = "status IN ('verified','open','closing-soon') AND (deadline IS NULL OR deadline_status = 'rolling' OR deadline >= TIMESTAMP '1998-06-15 10:00:00')"
_AI = "(category = 'AI film festival' OR ai_policy IN ('allowed','required'))"
_SHOW = "id, title, status, cast(deadline AS string) AS deadline, featured"
_URGENT = "ORDER BY featured DESC, deadline ASC NULLS LAST, id"


def _show(df: DataFrame) -> DataFrame:
    return df.select("id", "title", "status", F.col("deadline").cast("string").alias("deadline"), "featured")


def _page(spark: SparkSession, sf_dir: str, options: Options) -> DataFrame:
    return _show(ops.page(ops.catalogue(opportunities(spark, sf_dir), moment(NOW), options), options))


@query(f"WITH {OPPORTUNITIES} SELECT {_SHOW} FROM opportunities WHERE {_LISTED} {_URGENT} LIMIT 24")
def catalogue_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page by urgency."""
    return _page(spark, sf_dir, Options())


@query(f"WITH {OPPORTUNITIES} SELECT {_SHOW} FROM opportunities WHERE {_LISTED} ORDER BY discovered_at DESC, id LIMIT 24 OFFSET 24")
def catalogue_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the newest."""
    return _page(spark, sf_dir, Options(sort="newest", offset=24))


@query(f"WITH {OPPORTUNITIES} SELECT {_SHOW} FROM opportunities WHERE {_LISTED} AND entry_fee_amount = 0 AND prize_amount > 0 ORDER BY prize_amount DESC NULLS LAST, id LIMIT 50")
def catalogue_prize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free calls with a prize, by prize."""
    return _page(spark, sf_dir, Options(free_only=True, prize_only=True, sort="prize", limit=50))


@query(f"WITH {OPPORTUNITIES} SELECT {_SHOW} FROM opportunities WHERE {_LISTED} AND (lower(title) LIKE '%film prize%' OR lower(organizer) LIKE '%film prize%' OR lower(summary) LIKE '%film prize%' OR lower(location) LIKE '%film prize%') {_URGENT} LIMIT 24")
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over four columns with a sanitised text."""
    return _page(spark, sf_dir, Options(search="  Film%%  Prize! "))


@query(f"WITH {OPPORTUNITIES} SELECT {_SHOW} FROM opportunities WHERE {_LISTED} AND {_AI} AND category = 'Grant' AND ai_policy = 'required' {_URGENT} LIMIT 24")
def catalogue_ai_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AI calls of a category and policy."""
    return _page(spark, sf_dir, Options(ai_only=True, category="Grant", ai_policy="required"))


@query(f"WITH {OPPORTUNITIES} SELECT {_SHOW} FROM opportunities WHERE {_LISTED} AND deadline <= TIMESTAMP '{NOW}' + INTERVAL 14 DAY {_URGENT} LIMIT 50")
def catalogue_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing within 14 days; calls without a date never match."""
    return _page(spark, sf_dir, Options(closing_within=14, limit=50))


@query(f"WITH {OPPORTUNITIES} SELECT count(*) AS total, 24 AS \"offset\", greatest(0, least(24, count(*) - 24)) AS returned, count(*) > 24 + greatest(0, least(24, count(*) - 24)) AS has_more FROM opportunities WHERE {_LISTED}")
def catalogue_page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC5 W2: exact total and whether more pages follow."""
    o = Options(offset=24)
    return ops.page_info(ops.catalogue(opportunities(spark, sf_dir, "status", "deadline", "deadline_status"), moment(NOW), o), o)


@query(f"WITH {OPPORTUNITIES} SELECT count(*) AS all_open, count_if({_AI})::BIGINT AS ai_only, count_if(entry_fee_amount = 0)::BIGINT AS free, count_if(prize_amount > 0)::BIGINT AS with_prize, count_if(deadline <= TIMESTAMP '{NOW}' + INTERVAL 30 DAY)::BIGINT AS closing_30 FROM opportunities WHERE {_LISTED}")
def quick_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five quick-filter counts in one pass."""
    return ops.quick_counts(opportunities(spark, sf_dir), moment(NOW))


@query(f"""WITH {OPPORTUNITIES}, pages AS (
  SELECT id, title, 1 AS page, row_number() OVER ({_URGENT}) AS position FROM opportunities WHERE {_LISTED} QUALIFY position <= 30
  UNION ALL SELECT id, concat(title, ' (later)'), 2, row_number() OVER ({_URGENT}) - 20 FROM opportunities WHERE {_LISTED} QUALIFY row_number() OVER ({_URGENT}) BETWEEN 21 AND 50)
SELECT id, arg_max(title, page) AS title, min(page) AS first_page, arg_min(position, page)::INT AS first_position FROM pages GROUP BY id""")
def load_more_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later pages overwrite values, first places stay."""
    rows = ops.catalogue(opportunities(spark, sf_dir), moment(NOW))
    cut = [ops.page(rows, Options(limit=30, offset=o)).select("id", "title", *ops_order()) for o in (0, 20)]
    from pyspark.sql import Window

    w = Window.orderBy(*ops.ordering("urgent"))  # at most 30 rows
    one, two = (c.withColumn("position", F.row_number().over(w)).withColumn("page", F.lit(i + 1)) for i, c in enumerate(cut))
    two = two.withColumn("title", F.concat("title", F.lit(" (later)")))
    both = one.unionByName(two).select("id", "title", "page", "position")
    return ops.merge_pages(both, "id", "page", "position")


def ops_order() -> list[str]:
    return ["featured", "deadline"]


@query(f"WITH {OPPORTUNITIES} SELECT id, slug, title, status FROM opportunities WHERE slug = 'call-25' AND status IN ('verified','open','closing-soon','closed') LIMIT 1")
def slug_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one published call by its slug."""
    return ops.by_slug(opportunities(spark, sf_dir, "id", "slug", "title", "status"), "call-25")


@query(f"WITH {OPPORTUNITIES} SELECT id, status FROM opportunities WHERE review_decision = 'approved' AND NOT review_required AND verified_at IS NOT NULL AND status IN ('verified','open','closing-soon')")
def public_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the public view (row-level security)."""
    return ops.public_view(opportunities(spark, sf_dir)).select("id", "status")


@query(f"WITH {OPPORTUNITIES} SELECT id, tags FROM opportunities WHERE review_decision = 'pending' AND review_required AND NOT (tags LIKE 'platform:festhome%' OR tags LIKE 'festhome:%')")
def review_queue_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a human has to review."""
    return ops.review_queue(opportunities(spark, sf_dir, "id", "tags", "review_decision", "review_required"), "human").select("id", "tags")


@query(f"WITH {OPPORTUNITIES} SELECT id, tags FROM opportunities WHERE review_decision = 'pending' AND (tags LIKE 'platform:festhome%' OR tags LIKE 'festhome:%')")
def review_queue_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team-only rows."""
    return ops.review_queue(opportunities(spark, sf_dir, "id", "tags", "review_decision", "review_required"), "team").select("id", "tags")


@query(f"WITH {OPPORTUNITIES} SELECT id, status FROM opportunities WHERE status IN ('signal','discovered') OR review_required")
def before_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the fallback of tables without decisions."""
    return ops.before_workflow(opportunities(spark, sf_dir, "id", "status", "review_required"))[["id", "status"]]


@query(f"WITH {OPPORTUNITIES} SELECT id, title FROM opportunities WHERE lower(concat_ws(' ', title, organizer, summary, location, category, tags)) LIKE '%animation%' AND status IN ('verified','open','closing-soon')")
def refine_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client's haystack filter on verified rows."""
    return ops.refine(opportunities(spark, sf_dir), "Animation", "verified").select("id", "title")


@query(f"WITH {OPPORTUNITIES}, saved AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 10 = 0) SELECT id, title FROM opportunities WHERE id IN (SELECT id FROM saved)")
def refine_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved rows (a semi join)."""
    from .base import table

    saved = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_suppkey % 10 = 0").select(F.col("l_orderkey").alias("id"))
    return ops.refine(opportunities(spark, sf_dir), "", "saved", saved).select("id", "title")


@query("SELECT c_custkey, lower(c_name) IN ('customer#000000003', 'customer#000000008') AS authorized FROM customer")
def team_authorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """an allowlist that fails closed."""
    from .base import table

    return table(spark, sf_dir, "customer").select("c_custkey", ops.authorized(F.col("c_name"), " Customer#000000003, CUSTOMER#000000008 ,").alias("authorized"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(replace(c_name, '#', '@')) END AS email FROM customer""")
def identity_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """percent-decoded addresses."""
    from .base import table

    header = F.replace("c_name", F.lit("#"), F.when(F.col("c_custkey") % 2 == 0, "%40").otherwise("%23"))
    return table(spark, sf_dir, "customer").select("c_custkey", ops.identity_email(header).alias("email"))


@query("""SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'status' END, CASE WHEN o_orderkey % 3 = 0 THEN 'id' END], lambda x: x IS NOT NULL)), ',') AS offending
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def editable_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys of a change that may not be edited."""
    from .base import table

    k = F.col("o_orderkey")
    keys = F.array_compact(F.array(F.lit("title"), F.when(k % 2 == 0, "status"), F.when(k % 3 == 0, "id")))
    changes = F.map_from_arrays(keys, F.transform(keys, lambda _: F.lit("x")))
    out = table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(ops.offending_keys(changes, ["title", "summary"]), ",").alias("offending"))
    return out.where("offending <> ''")
