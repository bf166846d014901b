"""Extraction, identity, dedupe and matching queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import fields, review
from ..functions import text as T
from ..functions.similarity import jaro_winkler_udf
from ..operators import dedupe as ops
from ..operators import matching as match
from ..operators import metrics
from . import cases
from .base import OPPORTUNITIES, moment, opportunities, query, spread, table
from .text import identity_sql, match_sql

_NOTICE = """concat(title, '. Submissions are now open. ', CASE id % 5 WHEN 0 THEN 'The call is now closed. ' WHEN 1 THEN 'Open call, see rules and regulations. ' WHEN 2 THEN 'Convocatoria abierta. ' ELSE '' END,
 CASE id % 4 WHEN 0 THEN 'Entry fee: €20. ' WHEN 1 THEN 'Free entry. ' ELSE '' END, CASE id % 3 WHEN 0 THEN 'Films up to 15 minutes. ' ELSE '' END, CASE id % 6 WHEN 0 THEN 'AI-generated works are not accepted. ' WHEN 1 THEN 'Open to all filmmakers of the world. ' ELSE '' END, 'Submission deadline: ', {})"""
_NOTICES = f"{OPPORTUNITIES}, notices AS (SELECT id, {_NOTICE.format("strftime(discovered_at, '%Y-%m-%d')")} AS t, discovered_at FROM opportunities)"


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of calls, made from the opportunities."""
    rows = opportunities(spark, sf_dir, "id", "title", "discovered_at", heavy=True)
    return rows.select("id", F.expr(_NOTICE.format("date_format(discovered_at, 'yyyy-MM-dd')")).alias("t"), "discovered_at")


@query(f"""WITH {_NOTICES}, s AS (SELECT id, t, (regexp_matches(t, 'open[- ]?call\\b', 'i'))::INT + (regexp_matches(t, 'submissions? (?:are |is )?(?:now )?open\\b', 'i'))::INT + (regexp_matches(t, '\\b(?:submission|entry|application|final|early|regular|late|extended) deadlines?\\b', 'i') OR regexp_matches(t, '\\bdeadline\\s*[:\\-–]', 'i'))::INT
+ (regexp_matches(t, '\\bentry fees?\\b|\\brules (?:and|&) regulations\\b', 'i'))::INT + (regexp_matches(t, '\\bconvocatoria\\b', 'i'))::INT * 2 + 1 AS terms, regexp_matches(t, '\\bcall (?:are |is )?(?:now )?closed\\b', 'i') AS closed,
discovered_at >= TIMESTAMP '2000-05-29' AND discovered_at <= TIMESTAMP '2000-06-01' + INTERVAL 548 DAY AND discovered_at >= TIMESTAMP '2000-01-01' AS dated, regexp_matches(t, '2000|2001') AS y FROM notices)
SELECT id, terms, CASE WHEN dated THEN 1 ELSE 0 END AS dates, closed, least(terms, 4) * 2 + CASE WHEN dated THEN 3 ELSE 0 END + CASE WHEN y THEN 1 ELSE 0 END - CASE WHEN closed THEN 1 ELSE 0 END AS score, (dated OR y) OR terms >= 3 AS pass FROM s""")
def call_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is there an actionable call in a text."""
    s = X.call_signal(F.col("t"), moment("2000-06-01 12:00:00"))
    return notices(spark, sf_dir).withColumn("s", s).select("id", "s.terms", "s.dates", "s.closed", "s.score", "s.pass")


_FIELD_NAMES = "deadline, max_minutes, min_minutes, fee, fee_currency, ai_policy, premiere, eligibility"
_FIELD_CASES = cases.values(_FIELD_NAMES, [want for _, want in cases.FIELDS])
_TYPED = "deadline::VARCHAR AS deadline, max_minutes::INT AS max_minutes, min_minutes::INT AS min_minutes, fee::DOUBLE AS fee, fee_currency::VARCHAR AS fee_currency, ai_policy::VARCHAR AS ai_policy, premiere::VARCHAR AS premiere, eligibility"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases.dealt(spark, spread(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("id")), [given for given, _ in cases.FIELDS], "t string, title string")
    return rows.withColumn("d", fields.decision_fields(date(2026, 9, 28))(F.col("t"), F.col("title")))


@query(f"WITH {_FIELD_CASES} SELECT o_orderkey AS id, {_TYPED} FROM orders JOIN cases ON o_orderkey % {len(cases.FIELDS)} = k")
def decision_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3 X4 X5 X6 X7 X8 DT6 DT19: the facts of a call, one pass over each text that has any."""
    out = _facts(spark, sf_dir).select("id", "d.*").withColumns({"eligibility": F.array_join("eligibility", "|"), "deadline": F.col("deadline").cast("string")})
    return out.select("id", *_FIELD_NAMES.split(", "))


@query(f"""WITH {_FIELD_CASES}, f AS (SELECT o_orderkey AS id, {_TYPED}, CASE o_orderkey % 4 WHEN 0 THEN '2026-12-24' END AS old_deadline, CASE o_orderkey % 3 WHEN 0 THEN 'rolling' ELSE 'unknown' END AS old_status, CASE WHEN o_orderkey % 5 = 0 THEN 99 END AS old_minutes, CASE o_orderkey % 3 WHEN 1 THEN 'unclear' WHEN 2 THEN 'allowed' END AS old_policy, o_orderkey % 2 = 0 AS had FROM orders JOIN cases ON o_orderkey % {len(cases.FIELDS)} = k),
n AS (SELECT *, old_deadline IS NULL AND old_status <> 'rolling' AND deadline IS NOT NULL AS d, old_minutes IS NULL AND max_minutes IS NOT NULL AS m, fee IS NOT NULL AS e, old_policy IS DISTINCT FROM 'allowed' AND ai_policy IS NOT NULL AS p, NOT had AND eligibility <> '' AS g, premiere IS NOT NULL AS r FROM f)
SELECT id, CASE WHEN d THEN deadline ELSE old_deadline END AS deadline, CASE WHEN d THEN 'confirmed' ELSE old_status END AS deadline_status, CASE WHEN m THEN max_minutes ELSE old_minutes END AS max_minutes, fee, CASE WHEN e THEN fee_currency END AS fee_currency, CASE WHEN p THEN ai_policy ELSE old_policy END AS ai_policy, CASE WHEN g THEN eligibility WHEN had THEN 'members' ELSE '' END AS eligibility, premiere,
concat_ws(',', CASE WHEN d THEN 'deadline' END, CASE WHEN m THEN 'max_minutes' END, CASE WHEN e THEN 'fee' END, CASE WHEN p THEN 'ai_policy' END, CASE WHEN g THEN 'eligibility' END, CASE WHEN r THEN 'premiere' END) AS filled FROM n""")
def enriched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a page fill what a record lacks, and replace nothing."""
    k = F.col("id")
    known = {
        "deadline": F.when(k % 4 == 0, F.lit(date(2026, 12, 24))), "deadline_status": F.when(k % 3 == 0, "rolling").otherwise("unknown"), "max_minutes": F.when(k % 5 == 0, 99), "fee": F.lit(None).cast("double"), "fee_currency": F.lit(None).cast("string"),
        "ai_policy": F.when(k % 3 == 1, "unclear").when(k % 3 == 2, "allowed"), "premiere": F.lit(""), "eligibility": F.when(k % 2 == 0, F.array(F.lit("members"))).otherwise(F.array().cast("array<string>")),
    }
    out = _facts(spark, sf_dir).select("id", fields.filled(known, F.col("d")).alias("r")).select("id", "r.*")
    return out.select("id", F.col("deadline").cast("string").alias("deadline"), "deadline_status", "max_minutes", "fee", "fee_currency", "ai_policy", F.array_join("eligibility", "|").alias("eligibility"), F.when(F.col("premiere") != "", F.col("premiere")).alias("premiere"), F.concat_ws(",", "filled").alias("filled"))


@query(f"""WITH {OPPORTUNITIES} SELECT id, regexp_matches(title, '\\bAI[- ]film', 'i') AS ai_film, CASE WHEN category = 'AI film festival' THEN category WHEN regexp_matches(lower(title), 'grant|fund') THEN 'Grant' WHEN regexp_matches(lower(title), 'residen') THEN 'Residency'
WHEN regexp_matches(lower(title), '\\bai\\b') AND regexp_matches(lower(title), 'festival|film|cinema') THEN 'AI film festival' WHEN regexp_matches(lower(title), 'festival|film|cinema|open call|lab') THEN 'Traditional festival' END AS category FROM opportunities""")
def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by rule, the first that matches."""
    rows = opportunities(spark, sf_dir, "id", "title", "category")
    given = F.when(F.col("category") == "AI film festival", F.col("category"))
    return rows.select("id", X.is_ai_film(F.col("title")).alias("ai_film"), X.category_for(given, F.col("title"), F.lit("")).alias("category"))


@query(f"""WITH {OPPORTUNITIES}, {cases.values("geography", [want for _, want in cases.GEOGRAPHY])}, t AS (SELECT id, {match_sql("category || ' ' || title")} AS c FROM opportunities) SELECT id, CASE WHEN regexp_matches(c, '\\b(?:residency|artist in residence|research residency)\\b') THEN 'Residencies' WHEN regexp_matches(c, '\\b(?:grant|fund|funding|commission)\\b') THEN 'Grants / funding / commissions'
WHEN regexp_matches(c, '\\b(?:lab|fellowship)\\b') THEN 'Labs / fellowships' WHEN regexp_matches(c, '\\b(?:brand|advertising|creator challenge|hackathon)\\b') THEN 'Platform / branded challenges' WHEN regexp_matches(c, '\\bai\\b') THEN 'AI / generative film' WHEN regexp_matches(c, '\\b(?:festival|short film|filmmaking|film competition)\\b') THEN 'Film festivals / competitions' ELSE 'Other' END AS grp,
geography FROM t JOIN cases ON id % {len(cases.GEOGRAPHY)} = k""")
def report_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report buckets of categories and places, each place of the rules among them."""
    rows = cases.dealt(spark, opportunities(spark, sf_dir, "id", "title", "category"), [given for given, _ in cases.GEOGRAPHY], "place string")
    return rows.select("id", X.grouped(T.match_text(F.concat_ws(" ", "category", "title")), X.CATEGORY_GROUPS, "Other").alias("grp"), X.grouped(T.match_text(F.col("place")), X.GEOGRAPHY_GROUPS, "Other / Unclassified").alias("geography"))


@query(f"WITH {cases.values('discipline, ai_film', [want for _, want in cases.SUBJECTS])} SELECT c_custkey AS id, discipline, ai_film, c_custkey % 4 = 1 OR c_custkey % 3 = 1 AS ai_source FROM customer JOIN cases ON c_custkey % {len(cases.SUBJECTS)} = k")
def page_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages are about, and the sources of AI film."""
    k = F.col("id")
    rows = cases.dealt(spark, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), [given for given, _ in cases.SUBJECTS], "t string")
    family = F.when(k % 4 == 1, "ai-creative-tech").when(k % 4 == 2, "film-funding")
    kinds = F.when(k % 3 == 1, F.array(F.lit("grants"), F.lit("ai-film"))).when(k % 3 == 2, F.array(F.lit("grants")))
    return rows.select("id", X.discipline(F.col("t")).alias("discipline"), X.is_ai_film(F.col("t")).alias("ai_film"), X.is_ai_source(family, kinds).alias("ai_source"))


@query(f"WITH {cases.values('title, public, unresolved', [want for _, want in cases.TITLES])} SELECT o_orderkey AS id, title, public, unresolved FROM orders JOIN cases ON o_orderkey % {len(cases.TITLES)} = k")
def public_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX18 TX19: titles cleaned, and the names under which records are public."""
    rows = cases.dealt(spark, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), [given for given, _ in cases.TITLES], "raw string, organizer string")
    return rows.withColumn("p", T.public_title(F.col("raw"), F.col("organizer"))).select("id", T.clean_title(F.col("raw"), F.col("organizer")).alias("title"), F.col("p.title").alias("public"), "p.unresolved")


@query(f"""WITH {cases.values("title, public, unresolved", [want for _, want in cases.TITLES])}, r AS (SELECT o_orderkey AS id, public, unresolved, k FROM orders JOIN cases ON o_orderkey % {len(cases.TITLES)} = k), raw(k, title) AS (VALUES {", ".join(f"({k}, {cases.quoted(g[0])})" for k, (g, _) in enumerate(cases.TITLES))})
SELECT id, CASE WHEN NOT unresolved AND public <> '' AND public IS DISTINCT FROM raw.title THEN public END AS title, NULL::VARCHAR AS category FROM r JOIN raw USING (k)""")
def name_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the name of a published record changes."""
    rows = cases.dealt(spark, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), [given for given, _ in cases.TITLES], "title string, organizer string")
    return rows.withColumn("c", review.name_changes(F.col("title"), F.col("organizer"), F.lit("Residency"))).select("id", "c.title", "c.category")


def _reviewed() -> list[tuple]:
    """Record, page, duplicate and quote of each review case."""
    out = []
    for (record, page, duplicate, quote), _ in cases.REVIEWS:
        out.append((*(cases.RECORD | record).values(), None if page is None else tuple((cases.CHECK | page).values()), duplicate, quote))
    return out


@query(f"WITH {cases.values('decision, target, reasons, title, organizer, category', [want for _, want in cases.REVIEWS])} SELECT o_orderkey AS id, decision, target::VARCHAR AS target, reasons, title::VARCHAR AS title, organizer::VARCHAR AS organizer, category::VARCHAR AS category FROM orders JOIN cases ON o_orderkey % {len(cases.REVIEWS)} = k")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-3 R4: the automatic review of records and of what their pages show."""
    page = "page struct<" + ", ".join(x.replace(" ", ": ") for x in review.PAGE.split(", ")) + ">"
    rows = cases.dealt(spark, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), _reviewed(), f"{cases.REVIEW_RECORD}, {page}, duplicate boolean, quote boolean")
    d = review.auto_review(moment("2026-10-01 00:00:00"), F.col("page"), F.col("duplicate"), F.col("quote"))
    rows = rows.withColumn("deadline", F.col("deadline").cast("timestamp_ntz")).select("id", d.alias("d"))
    return rows.select("id", "d.decision", "d.target", F.array_join("d.reasons", ",").alias("reasons"), "d.title", "d.organizer", "d.category")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN o_totalprice END AS amount, CASE WHEN o_orderkey % 3 = 0 THEN 'EUR' WHEN o_orderkey % 3 = 1 THEN 'USD' END AS currency FROM orders""")
def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JM4 JM5 JM6: amounts and currencies that make sense."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    raw = F.when(p > 250000, p.cast("string")).when(k % 2 == 0, "-3").otherwise("many")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.amount(raw).alias("amount"), X.currency(F.when(k % 3 == 0, " eur ").when(k % 3 == 1, "usd").otherwise("€")).alias("currency"))


@query("""WITH p AS (SELECT c_custkey, lower(c_name) AS a, concat(substring(lower(c_name), 1, 16), reverse(substring(c_name, 17, 2)), lower(c_mktsegment)) AS b FROM customer), j AS (SELECT *, jaro_similarity(a, b) AS j FROM p)
SELECT c_custkey, round(j + 4 * 0.1::DOUBLE * (1 - j), 6) AS similarity FROM j""")
def jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX12: Jaro-Winkler with the prefix always counted (names against themselves with two digits swapped and a tail)."""
    name = F.lower("c_name")
    other = F.concat(F.substring(name, 1, 16), F.reverse(F.substring(name, 17, 2)), F.lower("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(jaro_winkler_udf(name, other), 6).alias("similarity"))


@query(f"""WITH {OPPORTUNITIES} SELECT id, sha256(concat_ws('|', {identity_sql('title')}, {identity_sql('organizer')}, coalesce(edition_year::VARCHAR, 'year-unknown'), 'edition unknown', {identity_sql('location')})) AS canonical, concat_ws('|', {identity_sql('title')}, edition_year::VARCHAR, {identity_sql('location')}) AS fuzzy FROM opportunities""")
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 D6 SK17: canonical and fuzzy keys."""
    rows = opportunities(spark, sf_dir, "id", "title", "organizer", "edition_year", "location", heavy=True)
    return rows.select("id", ops.canonical_key(F.col("title"), F.col("organizer"), F.col("edition_year"), F.lit(None).cast("string"), F.col("location")).alias("canonical"), ops.fuzzy_key(F.col("title"), F.col("edition_year"), F.col("location")).alias("fuzzy"))


def _to_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = opportunities(spark, sf_dir, "id", "organizer", "location", "category", "confidence", "official_url")
    k = F.col("id")
    return rows.select(k.alias("seq"), F.concat_ws("/", "organizer", (k % 3).cast("string")).alias("canonical"), F.concat_ws("/", "location", F.floor(k / 40).cast("string")).alias("fuzzy"), "confidence", "category", "official_url", F.array("category").alias("tags"))


#: The same fold by rounds: a row is decided once the earlier rows of its keys are.
_FOLD = f"""{OPPORTUNITIES}, n AS MATERIALIZED (SELECT id AS seq, concat_ws('/', organizer, (id % 3)::VARCHAR) AS c, concat_ws('/', location, floor(id / 40)::BIGINT::VARCHAR) AS z FROM opportunities), f AS (SELECT seq, c, z, NULL::BIGINT AS grp, 0 AS step FROM n UNION ALL
SELECT seq, c, z, CASE WHEN grp IS NOT NULL THEN grp WHEN cf < seq THEN cf WHEN coalesce(co < seq, false) THEN NULL WHEN zf < seq THEN zf WHEN coalesce(zo < seq, false) THEN NULL ELSE seq END, step + 1 FROM (
SELECT *, min(CASE WHEN grp = seq THEN seq END) OVER (PARTITION BY c) AS cf, min(CASE WHEN grp IS NULL THEN seq END) OVER (PARTITION BY c) AS co, min(CASE WHEN grp = seq THEN seq END) OVER (PARTITION BY z) AS zf, min(CASE WHEN grp IS NULL THEN seq END) OVER (PARTITION BY z) AS zo, count_if(grp IS NULL) OVER () AS open FROM f) WHERE open > 0),
folded AS (SELECT seq, grp FROM f QUALIFY step = max(step) OVER ())"""


@query(f"WITH RECURSIVE {_FOLD} SELECT seq, grp FROM folded")
def dedupe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered dedupe."""
    return ops.fold_duplicates(_to_fold(spark, sf_dir)).select("seq", "grp")


@query(f"""WITH RECURSIVE {_FOLD}, m AS (SELECT folded.*, confidence, category, official_url FROM folded JOIN opportunities ON id = seq)
SELECT grp, count(*) AS records, arg_max(seq, (confidence, -seq)) AS base, arg_min(category, (-confidence, seq)) FILTER (category IS NOT NULL) AS category, arg_min(official_url, (-confidence, seq)) FILTER (official_url IS NOT NULL) AS official_url, array_to_string(list_sort(list_distinct(list(category))), '|') AS tags FROM m GROUP BY grp""")
def dedupe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged records of the ordered dedupe."""
    merged = ops.merge_groups(ops.fold_duplicates(_to_fold(spark, sf_dir)), ["category", "official_url"], {"tags": 20})
    return merged.withColumn("tags", F.array_join("tags", "|"))


#: Customers as benchmark rows and suppliers as found records; the names of the columns differ as those of two sources would.
ITEM = [
    ("id", "c_custkey"),
    ("canonical_name", "concat(CASE c_custkey % 4 WHEN 0 THEN 'The ' ELSE '' END, 'Great ', lower(c_mktsegment), ' Short Film Prize of the Northern Harbour ', cast(c_custkey % 25 AS string), ' Shore', CASE c_custkey % 6 WHEN 5 THEN ' 2026' ELSE '' END)"),
    ("organizer", "CASE c_custkey % 9 WHEN 8 THEN '' ELSE concat('Org ', cast(c_custkey % 20 AS string)) END"),
    ("edition", "CASE c_custkey % 7 WHEN 3 THEN 'Third' END"),
    ("edition_year", "CASE c_custkey % 5 WHEN 0 THEN cast(2025 + c_custkey % 2 AS int) END"),
    ("call_year", "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 4 THEN NULL ELSE cast(2026 AS int) END"),
    ("country", "concat('Place ', cast(c_nationkey % 4 AS string))"),
    ("category", "CASE c_custkey % 3 WHEN 0 THEN 'Short film festival' WHEN 1 THEN '' ELSE 'Grant' END"),
    ("discovery_tier", "CASE c_custkey % 4 WHEN 0 THEN 'CORE' WHEN 1 THEN 'MAINSTREAM' WHEN 2 THEN 'HIDDEN' ELSE 'LONG_TAIL' END"),
    ("source_url", "CASE c_custkey % 8 WHEN 0 THEN concat('https://filmfreeway.com/p', cast(c_custkey % 50 AS string)) WHEN 1 THEN concat('http://www.host', cast(c_custkey % 20 AS string), '.org/') ELSE concat('https://host', cast(c_custkey % 20 AS string), '.org/call/', cast(c_custkey % 25 AS string), '/?utm_source=x') END"),
]
RECORD = [
    ("id", "s_suppkey"),
    ("title", "concat(CASE s_suppkey % 4 WHEN 1 THEN 'The ' ELSE '' END, 'Great ', element_at(array('building','machinery','automobile','furniture','household'), cast(1 + s_suppkey % 5 AS int)), ' Short Film Prize of the Northern ', CASE s_suppkey % 3 WHEN 0 THEN 'Harbor ' ELSE 'Harbour ' END, cast(s_suppkey % 25 AS string), ' Shore')"),
    ("organization", "concat('ORG ', cast(s_suppkey % 20 AS string))"),
    ("cycle", "CASE s_suppkey % 7 WHEN 3 THEN 'third' END"),
    ("opportunity_year", "CASE s_suppkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '2024' ELSE 'Call of 2026' END"),
    ("location", "concat('PLACE ', cast(s_nationkey % 4 AS string))"),
    ("type", "CASE s_suppkey % 3 WHEN 0 THEN 'Short film festival' WHEN 1 THEN '' ELSE 'Grant' END"),
    ("url", "CASE s_suppkey % 8 WHEN 0 THEN concat('https://filmfreeway.com/p', cast(s_suppkey % 50 AS string)) WHEN 1 THEN concat('https://host', cast(s_suppkey % 20 AS string), '.org/') ELSE concat('see https://host', cast(s_suppkey % 20 AS string), '.org/call/', cast(s_suppkey % 25 AS string)) END"),
]
_SEGMENT = "CASE s_suppkey % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' WHEN 2 THEN 'automobile' WHEN 3 THEN 'furniture' ELSE 'household' END"


def _view(name: str, columns: list[tuple[str, str]], of: str) -> str:
    body = ", ".join(f"{e} AS {n}" for n, e in columns)
    return f"{name} AS (SELECT {body} FROM {of})".replace("element_at(array('building','machinery','automobile','furniture','household'), cast(1 + s_suppkey % 5 AS int))", _SEGMENT)


_URL = "regexp_replace(regexp_replace(regexp_extract({}, 'https?://(.*)', 1), '^www\\.', ''), '(?:/\\?utm_source=x)$', '')"
_WORDS = "list_distinct(list_filter(string_split({}, ' '), lambda x: x <> ''))"
_SERIES = "trim(regexp_replace(regexp_replace(regexp_replace({}, '\\b(?:19|20)[0-9]{{2}}\\b', ' ', 'g'), '\\b[0-9]{{1,3}}(?:st|nd|rd|th)\\b', ' ', 'g'), ' +', ' ', 'g'))"
_PREFIX = "CASE WHEN substring(x, 1, 4) = substring(y, 1, 4) THEN 4 WHEN substring(x, 1, 3) = substring(y, 1, 3) THEN 3 WHEN substring(x, 1, 2) = substring(y, 1, 2) THEN 2 WHEN substring(x, 1, 1) = substring(y, 1, 1) THEN 1 ELSE 0 END"
_PAIRS = f"""{_view("items", ITEM, "customer")}, {_view("records", RECORD, "supplier")},
i AS (SELECT id AS a, lower(canonical_name) AS t, {_SERIES.format("lower(canonical_name)")} AS s, lower(organizer) AS o, lower(country) AS g, lower(edition) AS e, edition_year AS ey, coalesce(edition_year, call_year, CASE WHEN c_2026 THEN 2026 END) AS y, list_distinct(list_filter([edition_year, call_year, CASE WHEN c_2026 THEN 2026 END], lambda x: x IS NOT NULL)) AS ys, category AS k, {_URL.format("source_url")} AS u FROM (SELECT *, contains(canonical_name, '2026') AS c_2026 FROM items)),
r AS (SELECT id AS b, lower(title) AS t, {_SERIES.format("lower(title)")} AS s, lower(organization) AS o, lower(location) AS g, lower(cycle) AS e, regexp_extract(opportunity_year, '(20[0-9]{{2}})', 1)::INT AS y, type AS k, {_URL.format("url")} AS u FROM (SELECT * REPLACE (coalesce(opportunity_year, '0') AS opportunity_year) FROM records WHERE opportunity_year IS NOT NULL) UNION ALL SELECT id, lower(title), {_SERIES.format("lower(title)")}, lower(organization), lower(location), lower(cycle), NULL, type, {_URL.format("url")} FROM records WHERE opportunity_year IS NULL),
p AS (SELECT a, b, i.s AS x, r.s AS y, coalesce(i.e = r.e, false) AS ee, coalesce(i.e = r.e, false) OR coalesce(list_contains(i.ys, r.y), false) OR coalesce(i.y = r.y, false) AS ye, i.y <> r.y AS differ, i.u = r.u AS u, i.u AS url, regexp_extract(i.u, '^([^/]*)', 1) AS h, i.t = r.t AS t, i.s = r.s AS s, i.o = r.o AND i.o <> '' AS o, i.g = r.g AS g, i.k = r.k AND i.k <> '' AS k, regexp_extract(i.u, '^([^/]*)', 1) = regexp_extract(r.u, '^([^/]*)', 1) AND NOT regexp_matches(i.u, '^filmfreeway') AS own FROM i CROSS JOIN r),
q AS (SELECT *, url LIKE '%/' AS root, h = 'filmfreeway.com' AS shared FROM p WHERE NOT (NOT ye AND coalesce(differ, false))),
m AS (SELECT *, CASE WHEN u AND (CASE WHEN shared THEN t OR (s AND o) ELSE t OR s OR (o AND g AND ye) END) AND (NOT root OR (o AND (t OR s))) THEN 'canonical_url' WHEN o AND s AND ye THEN 'organizer_event_series_edition' WHEN t AND o AND g AND ye THEN 'title_organizer_geography_year' END AS method,
0.55::DOUBLE * (jaro_similarity(x, y) + ({_PREFIX}) * 0.1::DOUBLE * (1 - jaro_similarity(x, y))) + 0.45::DOUBLE * 2 * len(list_intersect({_WORDS.format("x")}, {_WORDS.format("y")})) / (len({_WORDS.format("x")}) + len({_WORDS.format("y")})) AS sim FROM q),
scored AS (SELECT a, b, coalesce(method, CASE WHEN sim >= 0.94::DOUBLE AND (o OR own) AND (ye OR g) AND o::INT + own::INT + ye::INT + g::INT + k::INT >= 2 THEN 'fuzzy_secondary' END) AS method, t, s, o, ee, ye, sim FROM m),
pairs AS (SELECT a, b, method, round(CASE method WHEN 'canonical_url' THEN least(0.999::DOUBLE, 0.97::DOUBLE + CASE WHEN t OR s THEN 0.012::DOUBLE ELSE 0 END + CASE WHEN ye THEN 0.008::DOUBLE ELSE 0 END + CASE WHEN o THEN 0.004::DOUBLE ELSE 0 END) WHEN 'organizer_event_series_edition' THEN CASE WHEN ee THEN 0.965::DOUBLE ELSE 0.955::DOUBLE END WHEN 'title_organizer_geography_year' THEN 0.935::DOUBLE ELSE least(0.929::DOUBLE, 0.88::DOUBLE + (sim - 0.94::DOUBLE) * 0.5::DOUBLE) END, 4) AS confidence FROM scored WHERE method IS NOT NULL)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer")).select(*[F.expr(e).alias(n) for n, e in ITEM])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "supplier")).select(*[F.expr(e).alias(n) for n, e in RECORD])


@query(f"WITH {_PAIRS} SELECT a, b, method, confidence FROM pairs")
def benchmark_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-7 J13 R14 TX13 W18 JM7: candidate pairs of a benchmark and the records, of all tiers, by blocking keys."""
    return match.candidates(match.normalized(_items(spark, sf_dir)), match.normalized(_records(spark, sf_dir))).select("a", "b", "method", "confidence")


#: Rows whose fields stand under other names, or in nested objects.
_RAW = """CASE c_custkey % 4 WHEN 0 THEN concat('{"event_series": "Inner ', cast(c_nationkey AS string), '", "organisation": "Nested House", "year": 2024, "officialUrl": "https://www.nested.org/a/"}') WHEN 1 THEN 'no json' WHEN 2 THEN '{"deadline": "until 5 May 2023", "Opportunità": "Bando"}' END"""


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'named ' || c_nationkey WHEN c_custkey % 4 = 2 THEN 'bando' ELSE '' END AS title_key, CASE WHEN c_custkey % 4 = 0 THEN 'nested house' ELSE '' END AS organizer_key,
CASE WHEN c_custkey % 3 = 0 THEN 'named ' || c_nationkey WHEN c_custkey % 4 = 0 THEN 'inner ' || c_nationkey ELSE '' END AS series_key, CASE c_custkey % 4 WHEN 0 THEN 2024 WHEN 2 THEN 2023 END::INT AS year, CASE WHEN c_custkey % 5 = 0 THEN 'festhome.com/f/1' WHEN c_custkey % 4 = 0 THEN 'nested.org/a' ELSE '' END || CASE WHEN c_custkey % 5 = 0 AND c_custkey % 4 = 0 THEN ' nested.org/a' ELSE '' END AS urls,
CASE WHEN c_custkey % 5 = 0 THEN 'structured/festhome' WHEN c_custkey % 4 = 0 THEN 'direct/official-or-publisher' ELSE 'unknown' END AS family FROM customer""")
def benchmark_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-9: fields by their aliases, in the row and in nested objects."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("Named "), F.col("c_nationkey").cast("string"))).alias("name"), F.expr(_RAW).alias("raw_payload"), F.when(k % 5 == 0, F.array(F.lit("https://festhome.com/f/1/"), F.lit("ftp://x"))).alias("sourceUrl"))
    n = match.normalized(rows)
    return n.select("id", "title_key", "organizer_key", "series_key", "year", F.array_join("urls", " ").alias("urls"), F.col("source_family").alias("family"))


#: The greedy assignment by rounds: a pair that is the best of both its sides is taken, its rivals fall.
_MATCH = f"""{_PAIRS}, o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY confidence DESC, CASE method WHEN 'canonical_url' THEN 4 WHEN 'organizer_event_series_edition' THEN 3 WHEN 'title_organizer_geography_year' THEN 2 ELSE 1 END DESC, a, b) AS ord FROM pairs),
lead_b AS (SELECT b, method, lead(method) OVER w AS m, confidence - lead(confidence) OVER w AS gap, row_number() OVER w AS rn FROM o WINDOW w AS (PARTITION BY b ORDER BY ord)), lead_a AS (SELECT a, method, lead(method) OVER w AS m, confidence - lead(confidence) OVER w AS gap, row_number() OVER w AS rn FROM o WINDOW w AS (PARTITION BY a ORDER BY ord)),
unclear_b AS (SELECT b FROM lead_b WHERE rn = 1 AND m = method AND round(gap, 9) <= 0.006 UNION SELECT r.b FROM r JOIN i ON r.u = i.u WHERE r.u LIKE 'filmfreeway.com/%' AND r.b NOT IN (SELECT b FROM pairs) GROUP BY r.b HAVING count(DISTINCT i.a) > 1), unclear_a AS (SELECT a FROM lead_a WHERE rn = 1 AND m = method AND m = 'fuzzy_secondary' AND round(gap, 9) <= 0.006),
g AS (SELECT a, b, ord, NULL::INT AS state, 0 AS step FROM o WHERE a NOT IN (SELECT a FROM unclear_a) AND b NOT IN (SELECT b FROM unclear_b) UNION ALL SELECT a, b, ord, CASE WHEN state IS NOT NULL THEN state WHEN ta OR tb THEN 0 WHEN ord = oa AND ord = ob THEN 1 END, step + 1 FROM (
SELECT *, coalesce(bool_or(state = 1) OVER (PARTITION BY a), false) AS ta, coalesce(bool_or(state = 1) OVER (PARTITION BY b), false) AS tb, min(CASE WHEN state IS NULL THEN ord END) OVER (PARTITION BY a) AS oa, min(CASE WHEN state IS NULL THEN ord END) OVER (PARTITION BY b) AS ob, count_if(state IS NULL) OVER () AS open FROM g) WHERE open > 0),
taken AS (SELECT a, b, state FROM g QUALIFY step = max(step) OVER ()), hits AS (SELECT items.*, taken.b IS NOT NULL AS hit, CASE WHEN taken.b IS NOT NULL THEN 'matched' WHEN id IN (SELECT a FROM unclear_a) THEN 'ambiguous_candidates' WHEN id IN (SELECT a FROM pairs) THEN 'candidate_collision_or_ambiguous_record' ELSE 'no_conservative_match' END AS outcome FROM items LEFT JOIN taken ON taken.a = id AND state = 1)"""
_RECALL = "count(*) AS total, count_if(hit)::BIGINT AS matched, round(count_if(hit)::DOUBLE / count(*), 4) AS recall, round(count_if(hit) * 100.0::DOUBLE / count(*), 2) AS percent"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match(match.normalized(_items(spark, sf_dir)), match.normalized(_records(spark, sf_dir)))[1]


@query(f"WITH RECURSIVE {_MATCH} SELECT 'overall' AS dimension, 'all' AS label, {_RECALL} FROM hits UNION ALL SELECT 'category', discovery_tier, {_RECALL} FROM hits GROUP BY 2 UNION ALL SELECT 'place', country, {_RECALL} FROM hits GROUP BY 2")
def benchmark_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-8 M-9 E1 R15 JB12: one-to-one matches over all candidates, and the recall by tier and place."""
    rows = _items(spark, sf_dir).select(F.col("id").alias("a"), F.col("discovery_tier").alias("category"), F.col("country").alias("place")).join(_outcomes(spark, sf_dir), "a")
    return metrics.grouped_recall(rows.withColumn("hit", F.col("b").isNotNull()), ["category", "place"], "hit")


@query(f"WITH RECURSIVE {_MATCH} SELECT outcome, count(*) AS items FROM hits GROUP BY 1")
def benchmark_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-8: the items without a match, by reason."""
    return _outcomes(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("matched")).alias("outcome")).agg(F.count("*").alias("items"))


@query(f"""WITH {OPPORTUNITIES}, k AS (SELECT id, canonical_key, deadline, sha256(title) AS h FROM opportunities), d AS (SELECT canonical_key, count(*) AS n, count(DISTINCT h) AS titles FROM k GROUP BY 1)
SELECT count(*) AS keys, count_if(n > 1)::BIGINT AS duplicate_keys, (SELECT count(*) FROM k WHERE canonical_key IS NULL) AS missing FROM d""")
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK17 JB22: missing and duplicate keys."""
    k = opportunities(spark, sf_dir, "id", "canonical_key")
    n = k.groupBy("canonical_key").agg(F.count("*").alias("n"))
    return n.agg(F.count("canonical_key").alias("keys"), F.count_if((F.col("n") > 1) & F.col("canonical_key").isNotNull()).alias("duplicate_keys"), F.coalesce(F.sum(F.when(F.col("canonical_key").isNull(), F.col("n"))), F.lit(0)).alias("missing"))
