"""Rule extractors: call signal, categories, report buckets, disciplines, tolerant JSON.

The call signal is a sum of native pattern tests.
"""

from __future__ import annotations

import json
import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .dates import mentions_upcoming_year, upcoming

#: An ASCII word boundary, which Java's own is not.
BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Phrases that announce a call (fixed patterns).
CALL_TERMS = [
    r"\bcall (?:for|to) (?:entr|submission|film|work|project|application|artist|proposal)",
    r"\bopen[- ]?call\b",
    r"\bsubmissions? (?:are |is )?(?:now )?open\b|\bsubmit (?:your|a) (?:film|work|project|short)|\bnow accepting (?:submissions|entries|applications)",
    r"\b(?:submission|entry|application|final|early|regular|late|extended) deadlines?\b|\bdeadline\s*[:\-–]",
    r"\bapplications? (?:are |is )?(?:now )?open\b|\bapply (?:now|by|before|until)\b|\bhow to (?:apply|submit|enter)\b",
    r"\bentry fees?\b|\brules (?:and|&) regulations\b|\beligibility\b",
    r"\bbando\b|\bscadenza\b|\biscrizion[ei] (?:aperte|entro)|\bcandidature (?:aperte|entro)|\bregolamento\b",
    r"\bconvocatoria\b|\bfecha l[ií]mite\b|\binscripci(?:ón|ones) (?:abiertas|hasta)|\bbases (?:de|del) (?:concurso|festival|convocatoria)",
    r"\binscri(?:ç|c)(?:õ|o)es (?:abertas|até)|\bprazo (?:de|final)|\bedital\b|\bchamada (?:aberta|p[uú]blica)",
    r"\bappel (?:à|a) (?:films|projets|candidatures|courts)|\bdate limite\b|\binscriptions? (?:ouvertes|jusqu)|\br[eè]glement\b",
    r"\bausschreibung\b|\beinreich(?:ung|frist|schluss)|\bbewerbungs(?:schluss|frist)|\banmeldeschluss\b",
    r"\binzend(?:ing|en|termijn)|\baanmelden (?:kan|tot)|\bopen oproep\b",
    r"\bnab[oó]r (?:film|zgłosze|wniosk)|\btermin (?:nadsyłania|zgłosze)|\bzgłoszenia\b",
    r"\bbaşvuru(?:lar)? (?:açık|tarihi)|\bson başvuru\b",
    r"при[её]м заявок|дедлайн|крайний срок",
    r"προθεσμία|υποβολή (?:ταινιών|αιτήσεων)|πρόσκληση",
    r"\bsubmissions?\b|\bentry form\b|\benter your (?:film|work)",
    r"\bsubmit (?:now|here|today|your entry)\b|\benter (?:now|here|the (?:contest|competition|challenge))\b|\bregister (?:now|your film)\b|\bjoin the (?:contest|challenge|competition)\b|\bprize pool\b|\bcash prizes?\b",
    r"\bpostulaci(?:ón|on|ones)\b|\bplazo de (?:inscripci|presentaci)",
    r"\bcandidaturas?\b|\bsubmiss(?:ã|a)o de (?:filmes|obras)",
    r"\bconvocat(?:ò|o)ria\b|\binscripcions\b|\bdata l(?:í|i)mit\b",
    r"\bnevez(?:é|e)s|\bp(?:á|a)ly(?:á|a)zat|\bjelentkez(?:é|e)si",
    r"\bp(?:ř|r)ihl(?:á|a)(?:š|s)k|\buz(?:á|a)v(?:ě|e)rka",
    r"(?:î|i)nscrieri|termen(?:ul)? limit",
    r"\bans(?:ö|o)kan|\bans(?:ø|o)gning|\bs(?:ø|o)knad|\btilmelding|\bp(?:å|a)melding|\bhakuaika|\bhaku (?:on )?auki",
    r"\bpendaftaran\b|\bbatas waktu\b|\bpanggilan terbuka",
    r"hạn chót|hạn nộp|kêu gọi (?:tác phẩm|dự án)",
    r"รับสมัคร|ส่งผลงาน",
    r"הגשת|מועד אחרון|קול קורא",
    r"आवेदन|अंतिम तिथि",
    r"募集|応募|締切|締め切り|公募",
    r"공모|출품|마감|접수 ?기간",
    r"征集|征片|报名|截止|投稿",
    r"آخر موعد|باب التقديم|التقديم مفتوح|دعوة مفتوحة",
]
#: Phrases that close a call (fixed pattern).
CLOSED = (
    r"\b(?:submissions?|applications?|entries|call) (?:are |is )?(?:now )?closed\b|\b(?:submissions?|applications?|entries|registrations?)\s+(?:for|to)\s+[^.\n]{1,80}?\s+(?:are|is)\s+(?:now\s+)?closed\b"
    r"|\bno longer accepting\b|\bbando scaduto\b|\bconvocatoria cerrada\b|\binscri(?:ç|c)(?:õ|o)es encerradas\b|\bappel clos\b|\bbewerbungsfrist (?:ist )?abgelaufen\b|募集は終了|마감되었습니다|已截止"
)
#: AI film making, named as such (fixed pattern).
AI_FILM = (
    r"\bAI[- ](?:film|movie|video|short|cinema|generated|filmmak|animation|music video|creators?|storytell|ad\b|advert)|\bgenerative (?:AI|video|film|cinema)|\bAI[- ]assisted\b|\bmade with AI\b|\bartificial intelligence (?:film|cinema|video)"
    r"|\b(?:cine|cortos?|cortometrajes?|película|festival)\b[^.\n]{0,40}\b(?:IA|inteligencia artificial)\b|\bintelligenza artificiale\b|\bintelligence artificielle\b|\bKI[- ](?:Film|Kurzfilm)|AI映画|AI영화|AI 영화|AI电影|AI短片"
)


@cache
def java(pattern: str, fold: bool = True) -> str:
    """A pattern with ASCII word boundaries for Java, ignoring case if ``fold``.

    A boundary before a word or a group of words becomes a look-behind, any other a look-ahead: one test
    for each, where the general form would take four. Before a letter it is tested after the letter, which
    far fewer places have.
    """
    pattern = re.sub(r"\\b([A-Za-z])(?![?*+{])", r"\1(?<![A-Za-z0-9_]\1)", pattern)
    before = re.sub(r"\\b(?=\(|\w)", r"(?<![A-Za-z0-9_])", pattern)
    return ("(?iu)" if fold else "") + before.replace(r"\b", r"(?![A-Za-z0-9_])")


@cache
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\b", BOUNDARY).replace(r"\w", "[A-Za-z0-9_]").replace(r"\d", "[0-9]"), re.IGNORECASE)


def call_signal(text: Column, now: Column, lenient: bool = False, most: int | None = None) -> Column:
    """(pass, score, terms, dates, next_date, upcoming_year, closed) of a page's text; ``most`` characters of it are read, all if None."""
    text = F.coalesce(text, F.lit(""))
    body = F.lower(text if most is None else F.substring(text, 1, most))  # the patterns are in lower case

    def facts(b: Column) -> Column:
        terms = sum((F.when(b.rlike(java(p, False)), 1).otherwise(0) for p in CALL_TERMS), F.lit(0))
        return F.struct(terms.alias("terms"), upcoming(b, now).alias("days"), mentions_upcoming_year(b, now).alias("year"), b.rlike(java(CLOSED, False)).alias("closed"))

    def judged(f: Column) -> Column:
        terms, days, year, closed = f["terms"], f["days"], f["year"], f["closed"]
        n = F.size(days)
        score = F.least(terms, F.lit(4)) * 2 + F.when(n > 0, 3).otherwise(0) + F.when(year, 1).otherwise(0) - F.when(closed, 1).otherwise(0)
        strict = ((terms >= 1) & ((n > 0) | year)) | (terms >= 3)
        ok = strict | (terms >= 1) | (n > 0) | year if lenient else strict
        return F.struct(ok.alias("pass"), score.alias("score"), terms.alias("terms"), n.alias("dates"), F.try_element_at(days, F.lit(1)).cast("string").alias("next_date"), year.alias("upcoming_year"), closed.alias("closed"))

    # one-element arrays bind the text and the facts, so that each is computed once, however often it is used
    return F.transform(F.transform(F.array(body), facts), judged)[0]


def is_ai_film(text: Column) -> Column:
    return F.coalesce(text.rlike(java(AI_FILM)), F.lit(False))


def is_ai_source(family: Column, categories: Column) -> Column:
    """A registered source of its own for AI film."""
    return F.coalesce(family == "ai-creative-tech", F.lit(False)) | F.coalesce(F.array_contains(categories, "ai-film"), F.lit(False))


def category_for(category: Column, title: Column, tags: Column) -> Column:
    """The category: the given one if known, else the first rule that the words meet (fixed rules); null if none."""
    given = F.trim(F.coalesce(category, F.lit("")))
    words = F.lower(F.concat_ws(" ", given, F.coalesce(title, F.lit("")), F.coalesce(tags, F.lit(""))))
    known = ["AI film festival", "Traditional festival", "Platform challenge", "Grant", "Residency", "Advertising competition"]
    ai = words.rlike(java(r"\bai\b|artificial intelligence|generative")) & words.rlike("festival|film|cinema")
    return (
        F.when(given.isin(known), given).when(words.rlike("grant|fund|fellowship|bursary|finanziament|subvention"), "Grant").when(words.rlike("residen|artist[- ]?in[- ]?residence|retreat"), "Residency")
        .when(words.rlike("advert|brand(?:ed)?|commercial|music video"), "Advertising competition").when(words.rlike("platform|challenge|hackathon|creator contest|video competition"), "Platform challenge")
        .when(ai, "AI film festival").when(words.rlike("festival|film|cinema|animation|moving image|screenplay|open call|exhibition|lab"), "Traditional festival")
    )


#: Report buckets of categories and places, the first that matches (fixed rules).
CATEGORY_GROUPS = [
    ("Music video", r"\b(?:music video)\b"), ("Animation", r"\b(?:animation|animated)\b"), ("Residencies", r"\b(?:residency|artist in residence|research residency)\b"), ("Grants / funding / commissions", r"\b(?:grant|fund|funding|commission)\b"),
    ("Labs / fellowships", r"\b(?:lab|fellowship|development programme|development program|co production forum)\b"), ("Platform / branded challenges", r"\b(?:brand|advertising|platform sponsored|creator challenge|hackathon)\b"), ("XR / immersive", r"\b(?:xr|immersive)\b"),
    ("Experimental / new media", r"\b(?:media art|new media|moving image|video art|digital art|experimental|art science|technology prize)\b"), ("AI / generative film", r"\b(?:ai|generative|human ai|artificial intelligence)\b"), ("Film festivals / competitions", r"\b(?:festival|short film|filmmaking|film competition)\b"),
]
GEOGRAPHY_GROUPS = [
    ("USA / Canada", r"\b(?:usa|united states|canada|north america)\b"),
    ("Latin America / Caribbean", r"\b(?:mexico|latin america|south america|central america|caribbean|argentina|bolivia|brazil|brasil|chile|colombia|costa rica|cuba|ecuador|guatemala|panama|paraguay|peru|puerto rico|uruguay|venezuela)\b"),
    ("Middle East", r"\b(?:mena|middle east|qatar|uae|united arab emirates|bahrain|iran|iraq|israel|jordan|kuwait|lebanon|oman|palestine|saudi arabia|syria|yemen)\b"),
    ("Oceania", r"\b(?:australia|new zealand|oceania|pacific islands?)\b"),
    ("Africa", r"\b(?:africa|algeria|angola|cameroon|egypt|ethiopia|ghana|kenya|morocco|nigeria|senegal|south africa|tunisia|uganda|zimbabwe)\b"),
    ("Asia", r"\b(?:asia|japan|china|hong kong|india|indonesia|korea|malaysia|philippines|singapore|taiwan|thailand|vietnam)\b"),
    ("Europe", r"\b(?:europe|eu|uk|united kingdom|england|scotland|wales|ireland|italy|france|germany|spain|portugal|austria|belgium|bulgaria|croatia|czech|denmark|finland|greece|hungary|iceland|netherlands|norway|poland|romania|serbia|slovakia|slovenia|sweden|switzerland)\b"),
    ("Global / International", r"\bglobal\b|\binternational\b"),
]


def grouped(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The first bucket whose pattern a normalised text meets."""
    out = F.when(text == "", "Unknown")
    for name, pattern in rules:
        out = out.when(text.rlike(java(pattern)), name)
    return out.otherwise(other)


def amount(c: Column) -> Column:
    """A number that is not negative, else null."""
    n = c.cast("string").try_cast("double")
    return F.when((n >= 0) & ~F.isnan(n), n)


def currency(c: Column) -> Column:
    t = F.upper(F.trim(F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, 3)))
    return F.when(t.rlike("^[A-Z]{3}$"), t)


#: What a page is about: film, every discipline, another one (fixed patterns).
PAGE_FILM = r"\b(?:films?|filmmak\w*|cinema\w*|moving[- ]images?|audiovisual|documentar(?:y|ies)|animation|animated|video[- ]?art\w*|media[- ]arts?|screenwrit\w*|short\s+films?|cortometr\w*|largometr\w*|court[- ]m[ée]trage\w*|kurzfilm\w*|documentaire|documental)\b|映像|映画|영화|영상|电影|影像"
ALL_DISCIPLINES = (
    r"\b(?:all|any|every)\s+(?:artistic\s+)?(?:disciplines?|media|mediums|art\s+forms?|fields)\b|\b(?:inter|multi|trans|cross)[- ]?disciplinary\b|\bartists?\s+(?:of|from|working\s+in)\s+(?:all|any)\s+(?:disciplines?|media|fields)\b"
    r"|\btutte\s+le\s+discipline\b|\btodas\s+las\s+disciplinas\b|\btoutes\s+(?:les\s+)?disciplines\b|\balle\s+(?:künstlerischen\s+)?(?:disziplinen|sparten)\b"
)
OTHER_DISCIPLINE = r"\b(?:illustrat\w*|literature|literary|poetry|painting|sculpture|ceramics|architecture|photograph\w*|comics?|manga)\b|イラスト|文学|絵画|写真"


def discipline(text: Column) -> Column:
    """film, all, other or none: what a page is about."""
    return F.when(text.rlike(java(PAGE_FILM)), "film").when(text.rlike(java(ALL_DISCIPLINES)), "all").when(text.rlike(java(OTHER_DISCIPLINE)), "other").otherwise("none")


def tolerant_json(text: str | None) -> list[dict]:
    """The objects of a model's answer: fences are stripped, and a truncated array keeps its whole objects."""
    body = re.sub(r"^\s*```(?:json)?|```\s*$", "", text or "").strip()
    try:
        value = json.loads(body)
    except ValueError:
        value, depth, start, quoted, skip = [], 0, None, False, False
        for i, c in enumerate(body):
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c == "{":
                start = i if depth == 0 or (depth == 1 and body.lstrip().startswith('{"')) and start is None else start
                depth += 1
            elif c == "}" and depth:
                depth -= 1
                if depth == 0 and start is not None:
                    try:
                        value.append(json.loads(body[start : i + 1]))
                    except ValueError:
                        pass
                    start = None
    if isinstance(value, dict):
        value = next((v for v in value.values() if isinstance(v, list)), [value])
    return [v for v in value if isinstance(v, dict) and v.get("relevant", True)][:5] if isinstance(value, list) else []


@F.pandas_udf(ArrayType(StringType()))
def json_objects(texts: pd.Series) -> pd.Series:
    """The objects of model answers, each as JSON text."""
    return texts.map(lambda t: [json.dumps(x, sort_keys=True) for x in tolerant_json(t)])
