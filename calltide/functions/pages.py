"""Facts that one page states: a grant's page, a lead's own page, an opportunity in visible content, the best deadline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import html as H
from . import text as T
from . import url as U
from .dates import day_month_year
from .extract import is_ai_film, java
from .records import yearless_deadline

#: Names of public bodies that fund (fixed pattern).
FUNDERS = r"\b(?:film\s+commission|regione|fondazione|ministero|mic|comune|provincia|fondo|istituto|camera|commission|agenzia|universit[aà]|cinecitt[aà]|direzione|dipartimento|assessorato|siae|rai|ente)\b"
#: Paths of articles, blog hosts, and folders of a site's own documents (fixed patterns).
ARTICLE = r"(?i)/(?:articolo|articoli|article|news|notizie|events?|eventi|blog|post|magazine|[0-9]{4}/[0-9]{2})/"
BLOGS = r"(?:^|\.)(?:blogspot\.com|wordpress\.com|medium\.com|substack\.com)$"
DOCUMENTS = r"/wp-content/uploads/|/(?:bandi?|regolament\w*|call|docs?|download)"
#: Titles that name an opportunity, headings that name none, links that lead to an application, directories (fixed patterns).
OPPORTUNITY = (
    r"festival|competition|contest|challenge|grant|fund(?:ing)?|residen(?:cy|ce)|fellowship|\blab\b|\bawards?\b|\bprize\b|\bpremio\b|\bprix\b|\bpreis\b|open call|call for (?:entries|projects|submissions)|submissions? open|convocatoria|edital|bando|concorso|appel (?:a|à) projets"
    r"|einreichung|wettbewerb|映像.{0,8}(?:公募|募集)|미디어아트.{0,8}공모|影像艺术.{0,8}(?:征集|公開徵集)|دعوة.{0,8}(?:أفلام|مشاريع)"
)
HEADING = r"(?iu)^(?:open calls?|calls? for (?:entries|projects)|opportunities|applications?|submissions?|grants?|funding|residencies|festivals?|(?:film\s+)?festivals?\s+list(?:ings?)?|(?:film\s+)?festivals?\s+submissions?\s*(?:&|and)\s*deadlines?|get\s+funding\s*(?:&|and)\s*support|competitions?|challenges?|news)(?:\s+20[0-9]{2})?$"
APPLY = r"(?iu)apply|application|submit|submission|enter now|entries|register|inscri(?:ção|ções|coes)|inscripciones?|candidature|bewerbung|応募|申請|신청|제출|报名|提交|التقديم|تقديم"
DIRECTORY = r"(?iu)directory|browse all|all opportunities|all festivals|search festivals|filter by|results found|opportunity directory"
INVITES = r"(?iu)open call|submissions? open|call for (?:entries|projects|submissions)"
SAYS_OPEN = r"\b(?:applications?|submissions?|entries)\s+(?:are\s+|now\s+)?open\b|\bopen\s+for\s+(?:applications?|submissions?|entries)\b"
SAYS_CLOSED = r"\b(?:applications?|submissions?|entries)\s+(?:are\s+|now\s+)?closed\b|\b(?:no longer|not)\s+accepting\s+(?:applications?|submissions?|entries)\b"


def _nothing(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def grant_facts(text: Column, html: Column, links: Column) -> Column:
    """(title, opening, closing, closing_quote, status, funder, link) of an Italian grant's page; ``links`` is an array of (url, text)."""

    def of(x: Column) -> Column:
        body, page = x["text"], x["html"]
        at = F.call_function("instr", body, F.lit("Scheda bando"))
        head = F.when(at > 0, F.substring(body, at, F.lit(600))).otherwise(F.substring(body, 1, 600))
        day = lambda label: F.regexp_extract(head, rf"{label}:\s*([0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}})", 1)
        closing = day("Scadenza sessioni")
        heading = T.squeeze(F.regexp_replace(F.regexp_replace(F.regexp_extract(page, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " "), "&[a-z]+;", " "))
        title = F.coalesce(_nothing(heading), _nothing(F.regexp_extract(page, r"(?i)<title>([^<|]+)", 1)))
        contact = F.trim(F.regexp_extract(body, r"Contatti dell'ente\s+(.{2,120}?)\s+(?:Responsabile|Telefono|Email|E-mail|Link al bando|Sito)", 1))
        link = F.try_element_at(F.filter(x["links"], lambda r: r["text"].rlike("(?i)link al bando")), F.lit(1))["url"]
        return F.struct(
            title.alias("title"), day_month_year(day("Apertura sessioni")).alias("opening"), day_month_year(closing).alias("closing"), F.when(closing != "", F.concat(F.lit("Scadenza sessioni: "), closing)).alias("closing_quote"),
            _nothing(F.regexp_extract(head, java(r"\b(Aperto|Chiuso|In arrivo|Prossimamente)\b", False), 1)).alias("status"), F.when(contact.rlike(java(FUNDERS)), contact).alias("funder"), F.when(~link.rlike(r"(?i)italyformovies\."), link).alias("link"))

    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    return T.bound(F.struct(body.alias("text"), F.coalesce(html, F.lit("")).alias("html"), links.alias("links")), of)


def lead_call_page(name: Column, url: Column, title: Column, exclude: list[str]) -> Column:
    """A result is the call's own document, or a page whose path names the call, on no excluded or blog host and in no news folder."""
    host, path = U.host(url), F.lower(F.coalesce(F.try_url_decode(U.path(url)), U.path(url)))
    words = F.filter(F.split(T.fold(F.lower(F.coalesce(name, F.lit("")))), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)

    def of(x: Column) -> Column:
        named = lambda t: F.size(F.filter(x["words"], lambda w: t.contains(w))) / F.size(x["words"]) >= 0.6
        own = F.when(x["path"].endswith(".pdf"), x["path"].rlike(DOCUMENTS) & (named(x["path"]) | named(F.lower(F.coalesce(title, F.lit("")))))).otherwise(~x["path"].rlike(ARTICLE) & named(x["path"]))
        return F.when(F.size(x["words"]) > 0, own)

    allowed = host.isNotNull() & ~U.host_in(host, exclude) & ~F.coalesce(host.rlike(BLOGS), F.lit(False))
    return allowed & F.coalesce(T.bound(F.struct(words.alias("words"), F.coalesce(path, F.lit("")).alias("path")), of), F.lit(False))


def best_deadline(dated: Column, quote: Column, closes: Column, text: Column, now: Column) -> Column:
    """(deadline, status, method): a dated statement that is not past, else the page's structured data, else a day whose year the page leaves out."""
    today = F.date_sub(F.to_date(now), 1)
    structured = F.when(closes.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(closes, 1, 10).try_cast("date"))
    inferred = yearless_deadline(text, now)
    return F.coalesce(
        F.when(dated >= today, F.struct(dated.alias("deadline"), F.lit("confirmed").alias("status"), F.lit("dated").alias("method"), quote.alias("quote"))),
        F.when(structured >= today, F.struct(structured.alias("deadline"), F.lit("confirmed").alias("status"), F.lit("json-ld").alias("method"), F.concat(F.lit("schema.org validThrough: "), F.substring(closes, 1, 25)).alias("quote"))),
        F.when(inferred.isNotNull(), F.struct(inferred.alias("deadline"), F.lit("estimated").alias("status"), F.lit("year-inferred").alias("method"), F.lit(None).cast("string").alias("quote"))),
    )


def stated_status(text: Column) -> Column:
    """open or closed, if the head of a page says one of them."""
    head = F.substring(text, 1, 6000)
    a, b = head.rlike(java(SAYS_OPEN)), head.rlike(java(SAYS_CLOSED))
    return F.when(a & ~b, "open").when(b & ~a, "closed")


def page_category(text: Column) -> Column:
    has = lambda p: text.rlike("(?iu)" + p)
    return (
        F.when(has("advertis|branded|commercial|music video"), "Advertising competition").when(has("residen(?:cy|ce)|artist-in-residence|artist in residence"), "Residency").when(has("grant|fund(?:ing)?|fondo|fomento|edital|commission"), "Grant")
        .when(is_ai_film(text) & has("festival|awards?|contest|competition|prize|cinema"), "AI film festival")
        .when(has("platform|creator challenge|generative video|AI video|artificial intelligence"), F.when(has("festival"), "AI film festival").otherwise("Platform challenge")).otherwise("Traditional festival")
    )


def page_extraction(html: Column, text: Column, links: Column, deadline: Column) -> Column:
    """(disposition, reason, title, organizer, category, application_url, remote, status) of a page that shows one opportunity.

    ``links``: an array of (url, text); ``deadline``: the page's best one, or null. What is a list, or shows no clear opportunity, is ambiguous.
    """

    def of(x: Column) -> Column:
        title, apply = x["title"], x["apply"]
        many = (F.size(apply) > 10) | (F.concat_ws(" ", H.heading(html), F.substring(text, 1, 2000)).rlike(DIRECTORY) & (F.size(apply) > 2))
        named = title.rlike(java(OPPORTUNITY)) | is_ai_film(title)
        invited = F.concat_ws("\n", title, F.substring(text, 1, 12_000)).rlike(INVITES)
        application = F.try_element_at(apply, F.lit(1))["url"]
        reason = (
            F.when(title.isNull() | F.trim(title).rlike(HEADING) | ~named, "NO_STRONG_TITLE_SIGNAL").when(many, "MULTI_ITEM_DIRECTORY")
            .when(application.isNull() & deadline.isNull() & ~invited, "NO_APPLICATION_OR_DEADLINE").otherwise("VISIBLE_DETAIL_PAGE")
        )
        organizer = F.when(~x["organizer"].rlike("(?i)^(?:home|homepage|welcome|index)$"), x["organizer"])
        remote = F.substring(text, 1, 8000).rlike(java(r"\b(?:online|remote|worldwide)\b"))
        record = F.struct(
            title.alias("title"), F.coalesce(organizer, F.lit("Unknown organizer")).alias("organizer"), page_category(F.concat_ws(" ", title, x["organizer"])).alias("category"), application.alias("application_url"), remote.alias("remote"),
            stated_status(text).alias("status"))
        complete = reason == "VISIBLE_DETAIL_PAGE"
        return F.struct(F.when(complete, "complete").otherwise("ambiguous").alias("disposition"), reason.alias("reason"), F.when(complete, record).alias("record"))

    event = H.json_ld_event(html)
    title = F.coalesce(event["name"], H.heading(html), H.meta(html, "og:title"), H.title(html))
    organizer = F.coalesce(event["organizer"], H.meta(html, "og:site_name"))
    apply = F.filter(links, lambda r: F.concat_ws(" ", r["text"], r["url"]).rlike(APPLY))
    return T.bound(F.struct(title.alias("title"), organizer.alias("organizer"), apply.alias("apply")), of)
