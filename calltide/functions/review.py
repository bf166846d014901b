"""The automatic review: an ordered decision table over a record and the check of its page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import ALL_DISCIPLINES, OTHER_DISCIPLINE, java
from .scoring import blockers, days_between, team_only
from .text import bound, clean_organizer, distinctive, is_generic_title, public_title
from .url import host

#: Titles of lists, finished editions, other arts, deadline tiers and of what is no call (fixed patterns).
LISTING = r"^(?:festival\s+(?:list|directory)|funding\s+(?:overview|deadlines)|get\s+funding(?:\s+and\s+support)?|festival\s+submissions?\s*(?:&|and)\s*deadlines(?:\s+20\d{2})?|open\s+calls\s*[|:–-].*|opportunities|all\s+opportunities|awesome\b.*|.*\bdata\s+api\b.*|.*\bdirectory\b.*|.*\boverview\b.*)$"
PLURALS = r"\b(?:festivals|events|competitions|contests|awards|grants|residencies|opportunities|calls|deadlines|challenges)\b"
TIER = r"^(?:early\s*-?\s*bird|earlybird|regular|late|final|extended|standard|last)?\s*deadlines?\b"
NO_CALL = r"\b(?:accreditations?|jur(?:y|ies)|volunteers?|tickets?|press\s+pass(?:es)?|internships?|jobs?|careers?|vacanc(?:y|ies)|hiring)\b"
FILM = r"\b(?:films?|filmmak\w*|cinem\w*|cine|kino|movies?|videos?|moving\s+image|animat\w*|screen\w*|audiovisual|documentar\w*|shorts?|music\s+videos?|media\s+arts?|new\s+media|digital\s+arts?|xr|vr|immersive|cortometr\w*|largometr\w*|court[- ]m[ée]trage|kurzfilm\w*|curta|longa)\b|映像|映画|動画|アニメ|영화|영상|애니메이션|电影|影像|動畫|视频"
#: Sites that are film institutions by name.
FILM_HOST = r"film|cine|kino|movie|video|docs$|dox|anim|screen|iff$|filmfest|tfl$|filmlab"
STAGE = r"\b(?:theatre|theater|dance|choreograph\w*|opera|musical|cabaret|circus|teatro|danza|th[ée][âa]tre|tanz)\b"
FILM_TITLE = r"\b(?:films?|filmmak\w*|cinema\w*|movies?|videos?|animat\w*|documentar\w*|screen\w*|cine|kino|tvc)\b"
RETROSPECT = r"\b(?:these\s+are|programme|program\s+schedule|line-?up|winners?|award-winning|highlights|recap|in\s+competition|(?:semi[- ]?|quarter[- ]?)?finalists?|official\s+selection|selected\s+(?:films|projects)|shortlist(?:ed)?|laureates?)\b"
CLOSED_TITLE = (
    r"\b(?:are|is)\s+(?:now\s+)?closed\b|\b(?:submissions?|applications?|entries|registrations?|call)\s+(?:now\s+)?closed\b|\bclosed\s+for\s+(?:submissions?|entries|applications?)\b"
    r"|\b(?:inscripciones|convocatoria)\s+cerradas?\b|\biscrizioni\s+chiuse\b|\binscriptions?\s+(?:sont\s+)?(?:closes|fermées)\b"
)
NOT_YET = r"\b(?:stay\s+tuned|coming\s+(?:soon|up)|will\s+open|opens?\s+(?:on|in|soon)|save\s+the\s+date|pr[oó]ximamente|prossimamente|bient[oô]t)\b"
#: Pages that prove nothing about one call, posts, and the words by which a post is the call's own (fixed patterns).
LISTING_URL = r"[?&]page=|/news/?(?:[?#]|$)|/(?:opportunities|open-calls|calls|listings?)/?(?:[?#]|$)"
POST_URL = r"/(?:blog|news|noticias|novedades|actualit[eé]s?|notizie|nachrichten|articles?|posts?)/[^/?#]+"
CALL_SLUG = r"call|entr(?:y|ies)|submi(?:t|ssion)|convocatoria|bando|inscripci|iscrizion|appel|einreich|ausschreibung|appl(?:y|ication)|open|deadline|competition|concurso|concorso|award|prize|premio|fund|grant|residen|fellowship|lab\b"
#: Hosts or organizers that write about the calls of others.
PUBLICATION = r"mag(?:azine)?\b|magazine|news|blog|journal|press|guide|contests|festivals|opportunit|resource|recursos|directory|listings?|media\b"
AI_NAME = r"\b(?:AI|A\.I\.|IA|KI)\b[^|]{0,30}?\b(?:film|films|filmfest|cinema|movies?|video|shorts?)\b|\b(?:AI|IA)[- ]?(?:film|cinema|movie)|\bgenerative\s+(?:film|cinema|video)"
EVENT_NAME = r"festival|filmfest|\bfest\b|awards?|contest|competition|challenge|prize|cinema"
#: What is known of the official page when a record is judged.
PAGE = "ok boolean, http_status int, final_url string, closed boolean, call_signal boolean, date_found boolean, open_found boolean, film boolean, all_disciplines boolean, other_only boolean, directory boolean, year_found boolean, organizer string"


def has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(java(pattern)), F.lit(False))


def site_label(url: Column) -> Column:
    """The host without its last label, letters and digits only."""
    labels = F.split(host(url), r"\.")
    return F.regexp_replace(F.array_join(F.slice(labels, 1, F.greatest(F.lit(1), F.size(labels) - 1)), ""), "[^a-z0-9]", "")


def belongs(url: Column, title: Column, organizer: Column) -> Column:
    """The site carries a distinctive word of the title, or of an organizer that doesn't write about the calls of others."""
    label, org = site_label(url), clean_organizer(organizer)
    carries = lambda c: F.coalesce(F.exists(distinctive(c), lambda t: label.contains(t)), F.lit(False))
    own_portal = F.coalesce(host(url).rlike(r"(?:^|\.)ec\.europa\.eu$"), F.lit(False)) & has(organizer, r"^European Commission\b")
    return F.coalesce(label != "", F.lit(False)) & (own_portal | carries(title) | (carries(org) & ~has(F.concat_ws(" ", org, label), PUBLICATION)))


def name_category(category: Column, title: Column, organizer: Column) -> Column:
    """AI film festival where the name of a traditional festival or grant says so, else the category."""
    name = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(organizer, F.lit("")))
    return F.when(category.isin("Traditional festival", "Grant") & has(name, AI_NAME) & has(name, EVENT_NAME), "AI film festival").otherwise(category)


def name_changes(title: Column, organizer: Column, category: Column) -> Column:
    """(title, category) of a published record where its name changes them, else null."""
    org = clean_organizer(organizer)

    def changed(p: Column) -> Column:
        new = F.when(~p["unresolved"] & (p["title"] != "") & ~p["title"].eqNullSafe(title), p["title"])
        kind = name_category(category, F.coalesce(new, title), organizer)
        return F.struct(new.alias("title"), F.when(~kind.eqNullSafe(category), kind).alias("category"))

    return bound(public_title(title, org), changed)


def auto_review(now: Column, page: Column, duplicate: Column, open_quote: Column, published: bool = False) -> Column:
    """(decision, target, reasons, title, organizer, category) of a record: the first rule that holds; what nothing settles goes to a human.

    ``page`` is a struct of PAGE, missing if nothing was fetched; ``open_quote`` says that the organizer's page was quoted as open.
    The last three are what approval would change, else null.
    """
    c, title = F.col, F.trim(F.coalesce(F.col("title"), F.lit("")))
    known = lambda name: F.coalesce(page[name], F.lit(False))
    rolling, estimated = F.coalesce(c("deadline_status") == "rolling", F.lit(False)), F.coalesce(c("deadline_status") == "estimated", F.lit(False))
    days = days_between(c("deadline"), now)
    dated = F.coalesce((days > (0 if published else 2)) & c("deadline_status").isin("confirmed", "estimated"), F.lit(False))
    undated = c("deadline").isNull() & ~rolling & ~estimated & F.coalesce(open_quote, F.lit(False)) & (F.coalesce(c("application_url"), F.lit("")) != "")
    years = F.transform(F.regexp_extract_all(title, F.lit(java(r"\b(20\d{2})\b", False)), 1), lambda y: y.cast("int"))
    topic = F.concat_ws(" ", title, "summary", "category")
    film = (
        has(topic, FILM) | has(c("category"), "AI film festival") | has(c("organizer"), FILM) | has(site_label(F.coalesce(c("official_url"), c("source_url"))), FILM_HOST)
        | known("film") | has(topic, ALL_DISCIPLINES) | known("all_disciplines")
    )
    plural = F.size(F.regexp_extract_all(title, F.lit(f"({java(PLURALS)})"), 1)) >= 2
    url = F.coalesce(c("official_url"), page["final_url"])
    slug = F.element_at(F.filter(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), "/"), lambda x: x != ""), -1)
    post = has(url, POST_URL) & ~(belongs(url, title, F.lit("")) & has(F.coalesce(F.try_url_decode(slug), slug), CALL_SLUG))
    stated = F.trim(F.coalesce(c("organizer"), F.lit("")))
    has_organizer = (stated != "") & ~has(stated, r"^unknown(?:\s+organizer)?$")
    organizer = clean_organizer(F.when(has_organizer, stated).otherwise(F.coalesce(page["organizer"], stated)))
    target = F.when(estimated | undated, "verified").when(~rolling & (days <= 14), "closing-soon").otherwise("open")

    def judged(p: Column) -> Column:
        named, org = p["named"], p["org"]
        kind = name_category(c("category"), named["title"], org)
        # the candidate: as the record would be published
        rest = F.filter(blockers(target, now, url=url, url_status=F.when(known("ok"), "verified").otherwise(c("official_url_status"))), lambda b: b != "missing-organizer")
        reasons = F.concat(F.array_compact(F.array(
            F.when(~film, "no-film-relevance"), F.when(has(url, LISTING_URL), "listing-url").when(post, "news-post"), F.when(c("has_conflict"), "conflict"), F.when(has(c("review_reason"), "false-positive candidate"), "false-positive-flag"),
            F.when(F.coalesce(c("confidence"), F.lit(0.0)) < 0.5, "low-confidence"), F.when(~known("ok"), "page-not-ok"), F.when(known("ok") & known("closed"), "page-closed"), F.when(known("ok") & ~known("call_signal"), "no-call-signal"),
            F.when(known("ok") & ~rolling & ~undated & ~known("date_found"), "deadline-not-on-page"), F.when(known("ok") & undated & ~known("open_found"), "open-statement-not-on-page"),
            F.when(known("ok") & (rolling | undated) & (page["year_found"] == False), "year-not-on-page"),  # noqa: E712
            F.when(~has_organizer & page["organizer"].isNull(), "organizer-unknown"), F.when(named["unresolved"], "category-title"), F.when(~belongs(url, named["title"], org), "domain-mismatch"))), rest)
        steps = [
            (team_only(c("source_url")), "watch", "team-only"), (is_generic_title(title), "reject", "generic-title"), (duplicate, "archive", "duplicate"), (has(title, LISTING) | plural, "reject", "listing-title"), (has(title, TIER), "reject", "deadline-label"),
            (has(title, NO_CALL), "reject", "not-a-call"), (~film & (has(topic, OTHER_DISCIPLINE) | known("other_only")), "reject", "other-discipline"), (has(title, STAGE) & ~has(title, FILM_TITLE), "reject", "performing-arts"),
            (has(title, RETROSPECT) | F.coalesce(F.array_max(years) < F.year(now), F.lit(False)), "reject", "past-edition"), (known("directory"), "reject", "directory-page"), (has(title, CLOSED_TITLE), "reject", "closed-title"), (has(title, NOT_YET), "watch", "not-yet-open"),
            (~dated & ~rolling & ~undated, "watch", "no-actionable-deadline"),
        ]
        first = F.coalesce(*[F.when(holds, F.struct(F.lit(d).alias("decision"), F.array(F.lit(r)).alias("reasons"))) for holds, d, r in steps], F.when(F.size(reasons) > 0, F.struct(F.lit("human").alias("decision"), reasons.alias("reasons"))))
        found = F.coalesce(first, F.struct(F.lit("approve").alias("decision"), F.array().cast("array<string>").alias("reasons")))
        change = lambda new, old: F.when(~new.eqNullSafe(old), new)
        return bound(found, lambda x: F.struct(
            x["decision"].alias("decision"), F.when(x["decision"] == "approve", target).alias("target"), x["reasons"].alias("reasons"),
            F.when(x["decision"] == "approve", change(named["title"], c("title"))).alias("title"), F.when(x["decision"] == "approve", change(org, c("organizer"))).alias("organizer"), F.when(x["decision"] == "approve", change(kind, c("category"))).alias("category")))

    return bound(bound(organizer, lambda o: F.struct(o.alias("org"), public_title(title, o).alias("named"))), judged)
