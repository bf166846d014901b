"""Decision fields of a call: deadline, runtime, fee, AI policy, premiere rule, eligibility.

Each field is read from a statement of the page, and comes with its quote; what
is not stated, or stated in two ways, stays unknown. The sentence around a match decides
whether it counts, so the extractors run in Python, on Arrow batches. Native
tests come first (``GATES``): a field is only looked for in a text that has a word
which every way to state it needs, and texts without any are not sent at all.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import MONTH_OF, NAMES
from .extract import compiled

# --- fixed patterns ------------------------------------------------------------

#: Script or markup rather than a statement.
CODE = r"\\\"|\"\s*:\s*[\[{\"]|[{}\[\]]{2,}|\\x3c|\\u003c|</?[a-z][a-z0-9]*>"
#: A line that names a call.
CALL_NAME = r"\b20\d{2}\b|\b(?:lab|festival|grant|award|prize|fund|residenc\w*|competition|fellowship|programme|program)\b"
#: A rule of one category only.
ONE_CATEGORY = r"\b(?:this|that|each|the\s+\w+)\s+categor(?:y|ies)\b|\bexclusive\s+category\b|\bmusic\s+videos?\s+(?:have|has|pay|are)\b"
FILM = r"\b(?:films?|shorts?|works?|entr(?:y|ies)|submissions?|runtime|run\s+time|running\s+time|length|duration|videos?|pieces?|projects?|cortometragg\w*|cortometraj\w*|court[- ]m[ée]trage|kurzfilm\w*|durata|duraci\w*|dur[ée]e)\b|作品|영상|단편"
MINUTES = r"(?:minutes?|mins?\.?|minuti|minutos|minuten|분|分)"
LENGTH = r"(?:length|duration|running\s*time|runtime|durata|duraci[oó]n|dur[ée]e|l[äa]nge"
#: Ways to state a runtime; whether it is a range; whether the sentence must speak of films.
RUNTIME = [
    (rf"(?:max(?:imum)?\.?|maximal[e]?|massima|m[aá]xima|maximale|maximum)\s+(?:film\s+)?{LENGTH}|laufzeit)(?:\s+(?:is|of|de|di|von))?\s*[:\-–]?\s*(\d{{1,3}})\s*{MINUTES}", False, False),
    (rf"{LENGTH})\s*[:\-–]?\s*(?:max(?:imum)?\.?|up\s+to|no\s+(?:longer|more)\s+than|under|less\s+than|massim[ao]|m[aá]xim[ao]|jusqu'?[àa])\s*[:\-–]?\s*(\d{{1,3}})\s*{MINUTES}", False, False),
    (rf"(?:not\s+(?:to\s+)?exceed|up\s+to|no\s+longer\s+than|shorter\s+than|less\s+than|under|non\s+superiore\s+a|no\s+m[aá]s\s+de|hasta|ne\s+d[ée]passant\s+pas|bis\s+zu)\s+(\d{{1,3}})\s*{MINUTES}", False, True),
    (rf"(\d{{1,3}})\s*{MINUTES}\s*(?:max(?:imum)?\b|or\s+(?:less|shorter|under)|in\s+length\s+or\s+less)", False, True),
    (rf"(?:between\s+)?(\d{{1,3}})\s*(?:and|to|-|–|—|e|y|et|und)\s*(\d{{1,3}})\s*{MINUTES}", True, True),
    (r"최대\s*(\d{1,3})\s*분|(\d{1,3})\s*分以内", False, False),
]
FREE = (
    r"\b(?:free\s+(?:to\s+enter|entry|submissions?|of\s+charge\s+to\s+(?:enter|submit|apply))|no\s+(?:entry|submission|application)\s+fees?|(?:entry|submission|application)\s+(?:is|are)\s+free|free\s+of\s+charge"
    r"|gratuit[ae]?\s+(?:la\s+)?(?:partecipazione|inscripci[oó]n|participation)|inscripci[oó]n\s+gratuita|iscrizione\s+gratuita|inscri[çc][ãa]o\s+gratuita|participation\s+gratuite|kostenlos|geb[üu]hrenfrei)\b"
)
FEE = (
    r"(?:entry|submission|application|registration|early|regular|late|standard)?\s*(?:fees?|quota\s+(?:di\s+)?iscrizione|tasa\s+de\s+inscripci[oó]n|frais\s+d'inscription|teilnahmegeb[üu]hr|einreichgeb[üu]hr)\s*[:\-–]?\s*(?:(?:is|of|:|de|di)\s*)?"
    r"(?:(€|\$|£|¥|₩|EUR|USD|GBP|CAD|AUD)\s?(\d{1,4}(?:[.,]\d{1,2})?)|(\d{1,4}(?:[.,]\d{1,2})?)\s?(€|\$|£|EUR|USD|GBP|CAD|AUD|euros?|dollars?))"
)
NEAR_AMOUNT = r"(?:€|\$|£)\s?\d{1,4}|\d{1,4}\s?(?:€|EUR|USD|euros?)"
WAIVER = r"\b(?:free|waived|no\s+fee|gratuit[ae]?|gratis)\s+(?:for|per|para|pour|f[üu]r)\s+"
SYMBOLS = {"€": "EUR", "$": "USD", "£": "GBP", "¥": "JPY", "₩": "KRW", "EURO": "EUR", "EUROS": "EUR", "DOLLAR": "USD", "DOLLARS": "USD"}
AI = r"(?:\bai\b|\ba\.i\.|\bartificial\s+intelligence\b|\bgenerative\b|\bgen[- ]?ai\b|\bai[- ]generated\b|\bintelligenza\s+artificiale\b|\binteligencia\s+artificial\b|\bintelligence\s+artificielle\b|\bk[üu]nstliche\s+intelligenz\b)"
POLICY = [
    ("required", r"\b(?:non[- ]ai|without\s+ai|traditionally\s+filmed|live[- ]action)\b[^.\n]{0,80}\b(?:not\s+(?:be\s+)?(?:accepted|allowed|permitted|eligible)|prohibited)"),
    ("restricted", rf"(?<!non[- ])(?:{AI})[^.\n]{{0,60}}\b(?:not\s+(?:be\s+)?(?:accepted|allowed|permitted|eligible)|prohibited|forbidden|banned|disqualif)"),
    ("restricted", rf"\b(?:no|not\s+accept(?:ing)?|do\s+not\s+accept|does\s+not\s+accept|won'?t\s+accept|exclud(?:e|es|ing))\b[^.\n]{{0,40}}(?:{AI})"),
    ("required", rf"(?:made|created|produced|generated)\s+(?:entirely|fully|primarily|mainly|predominantly|exclusively)?\s*(?:with|using|by)\s+(?:{AI})|(?:fully|entirely|100%)\s+(?:ai[- ]generated|generated\s+(?:with|by)\s+ai\b)|must\s+(?:be\s+created\s+with|use|incorporate)\s+(?:{AI})"),
    ("allowed", rf"(?:{AI})[^.\n]{{0,50}}\b(?:accepted|allowed|permitted|welcome|eligible)\b|\b(?:accept|welcome|allow)s?\b[^.\n]{{0,30}}(?:{AI})[- ](?:assisted|generated|made)"),
]
#: A page that names an AI call, and a title that does.
AI_CALL = r"\bai[- ](?:film|short|video|cinema)\s+(?:festival|competition|contest|challenge|award)"
AI_TITLE = r"\b(?:ai|a\.i\.|artificial\s+intelligence|generative|gen[- ]?ai)\b"
PREMIERE = [
    ("none", r"\b(?:no\s+premiere\s+(?:status|requirements?)|premiere\s+status\s+(?:is\s+)?not\s+(?:required|necessary)|(?:regardless\s+of|no\s+restrictions?\s+on)\s+premiere)\b"),
    ("world", r"\b(?:world|international\s+and\s+world)\s+premi[eè]res?\b|\bprima\s+mondiale\b|\bestreno\s+mundial\b|\bpremi[eè]re\s+mondiale\b|\bweltpremiere\b|\buraufführung\b"),
    ("international", r"\binternational\s+premi[eè]res?\b|\bprima\s+internazionale\b|\bestreno\s+internacional\b|\bpremi[eè]re\s+internationale\b"),
    ("european", r"\beuropean\s+premi[eè]res?\b|\bprima\s+europea\b|\bestreno\s+europeo\b|\bpremi[eè]re\s+europ[ée]enne\b"),
    ("national", r"\b(?:national|country|italian|uk|british|french|spanish|german|us|north\s+american|canadian|australian|nordic|asian|latin\s+american)\s+premi[eè]res?\b|\bprima\s+(?:nazionale|italiana)\b|\bestreno\s+nacional\b|\bpremi[eè]re\s+(?:nationale|fran[çc]aise)\b"),
]
PREMIERE_RULE = r"requir|must|only|eligib|accept|premi[eè]re\s+status|obbligatori|obligatori|exig|vorausgesetzt"
PREMIERE_NOT = r"\b(?:not|no|doesn'?t|don'?t|without|regardless)\b[^.\n]{0,40}premi[eè]re|premi[eè]re[^.\n]{0,30}\b(?:not\s+(?:required|necessary|needed)|optional)\b"
ELIGIBLE = [
    r"\bopen\s+to\s+(?:all\s+)?(?:filmmakers|artists|applicants|creators|directors|students|anyone|everyone|participants)[^.\n]{0,90}",
    r"\b(?:open\s+(?:worldwide|internationally|to\s+all\s+countries|to\s+all\s+nationalities)|(?:filmmakers|artists|applicants|entries)\s+from\s+(?:all\s+over\s+the\s+world|any\s+country|all\s+countries|around\s+the\s+world)|no\s+nationality\s+restrictions?)\b",
    r"\b(?:must\s+be|applicants?\s+must\s+be)\s+(?:a\s+)?(?:resident|citizen|national|based|living|registered)s?\b[^.\n]{0,80}",
    r"\b(?:aged|ages?|age\s+limit|between\s+the\s+ages\s+of|under\s+the\s+age\s+of|over\s+the\s+age\s+of)\s*[:\-–]?\s*\d{2}[^.\n]{0,40}",
    r"\b(?:first|second|debut)\s+(?:and\s+second\s+)?(?:feature|film)s?\s+(?:only|directors?)\b[^.\n]{0,60}",
    r"\b(?:completed|produced|made)\s+(?:after|since|in\s+or\s+after|between)\s+[^.\n]{0,40}20\d{2}[^.\n]{0,40}",
]
CLOSING = (
    r"(?:final\s+)?deadline|submission\s+deadline|entries\s+close|submissions?\s+close|applications?\s+close|closing\s+date|due\s+date|apply\s+by|submit\s+by|scadenza|termine\s+(?:ultimo|di\s+presentazione)|fecha\s+l[ií]mite|cierre\s+de\s+(?:la\s+)?convocatoria|plazo"
    r"|prazo(?:\s+final)?|date\s+limite|cl[ôo]ture|einsendeschluss|einreichschluss|bewerbungsschluss|anmeldeschluss|締切|締め切り|마감|截止"
)
#: Words by which a date after a closing word belongs to something else.
FOREIGN = r"\b(?:updated|posted|published|modified|notif\w*|results?|announce\w*|ceremony|screenings?|winners?|festival\s+dates?)\b"
#: Forms of a date, the first that gives a real one counts; groups of year, month and day (none: a numeric one, if only one order is possible).
DATE_FORMS = [
    (r"(20\d{2})[-./](\d{1,2})[-./](\d{1,2})", (1, 2, 3)),
    (r"(20\d{2})\s*[年년]\s*(\d{1,2})\s*[月월]\s*(\d{1,2})\s*[日일]?", (1, 2, 3)),
    (rf"(\d{{1,2}})(?:st|nd|rd|th|er|º|°)?\.?\s+(?:de\s+)?({NAMES})\.?,?\s+(?:de\s+)?(20\d{{2}})", (3, 2, 1)),
    (rf"({NAMES})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(20\d{{2}})", (3, 1, 2)),
    (r"(\d{1,2})[/.](\d{1,2})[/.](20\d{2})", None),
]
TIER_HEADING = r"\b(?:deadlines|entry\s+deadlines|submission\s+deadlines|key\s+dates|important\s+dates|fechas\s+l[ií]mite|plazos|scadenze|fristen|dates\s+limites)\b\s*:?"
TIER = r"\s*[•·*\-–]?\s*((?:super\s+|very\s+|ultra\s+)?(?:early[\s-]?bird|early|regular|standard|official|late|extended|final|last|first|second|third)(?:\s+(?:deadline|call|entry|entries|submissions?))?)\s*[:\-–]\s*"
#: Words that distinguish no title.
TITLE_STOP = {"film", "films", "festival", "international", "call", "entries", "submissions", "submission", "open", "deadline", "deadlines", "competition", "award", "awards", "grant", "fund", "the", "for", "and", "global", "short", "shorts"}

#: For each field, words one of which every text with that field has (Java patterns).
GATES = {
    "runtime": r"(?iuU)[0-9]\s*(?:min|분|分)",
    "fee": r"(?iuU)fee|free|quota|tasa|frais|geb[üu]hr|gratuit|kostenlos",
    "ai_policy": r"(?iuU)(?<![a-z0-9_])(?:ai|a\.i\.|gen[- ]?ai)(?![a-z0-9_])|a\.i\.|artificial|intelligen|generative|filmed|action",
    "premiere": r"(?iuU)premi[eè]re|prima|estreno|aufführung",
    "eligibility": r"(?iuU)open\s+(?:to|worldwide|internationally)|from\s+(?:all|any|around)|restriction|must\s+be|age[sd]?(?:\s|[:\-–0-9])|limit|(?:feature|film)s?\s+(?:only|director)|(?:after|since|between)\s",
    "deadline": r"(?iuU)deadline|close|closing|due|apply|submit|scadenz|termine|fecha|cierre|plazo|prazo|dates?|cl[ôo]ture|schluss|fristen|締切|締め切り|마감|截止",
}


# --- extractors -----------------------------------------------------------------


def snippet(text: str, at: int, length: int) -> str:
    """The sentence around a match, of at most 60 characters on either side."""
    head, tail = text[max(0, at - 60) : at], text[at + length : at + length + 60]
    cut = max(head.rfind(x) for x in "\n.!?;")
    stop = re.search(r"[\n.!?;]", tail)
    return (head[cut + 1 :] + text[at : at + length] + tail[: stop.end() if stop else len(tail)]).strip()[:240]


def _has(pattern: str, text: str) -> bool:
    return compiled(pattern).search(text) is not None


def _one_line(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.category(c).startswith("M"))


def runtime(text: str) -> tuple[int, int | None, str] | None:
    """(most, least, quote) minutes."""
    for pattern, is_range, films in RUNTIME:
        m = compiled(pattern).search(text)
        if not m:
            continue
        n = [int(x) for x in m.groups() if x]
        if is_range and n[0] >= n[1]:
            continue
        most, quote = n[1] if is_range else n[0], snippet(text, m.start(), len(m[0]))
        if 0 < most <= 600 and not _has(CODE, quote) and (not films or _has(FILM, quote)):
            return most, n[0] if is_range else None, quote
    return None


def fee(text: str) -> tuple[float, str | None, str] | None:
    """(amount, currency, quote); nothing if the page states several, both a fee and none, or waives it for some."""
    free, paid = compiled(FREE).search(text), compiled(FEE).search(text)
    if paid and (free or _has(WAIVER, text)):
        return None
    if free:
        return 0.0, None, snippet(text, free.start(), len(free[0]))
    if not paid:
        return None
    amounts = {(m[2] or m[3]).replace(",", ".") for m in compiled(FEE).finditer(text)}
    near = {re.sub("[^0-9]", "", x) for x in compiled(NEAR_AMOUNT).findall(text[paid.start() : paid.start() + 300])}
    quote = snippet(text, paid.start(), len(paid[0]))
    if max(len(amounts), len(near)) > 1 or _has(CODE, quote) or _has(ONE_CATEGORY, quote):
        return None
    symbol = (paid[1] or paid[4]).upper()
    return float((paid[2] or paid[3]).replace(",", ".")), SYMBOLS.get(symbol, symbol), quote


def ai_policy(text: str, title: str | None = None) -> tuple[str, str] | None:
    ways = [*POLICY, ("required", AI_CALL)] if title and _has(AI_TITLE, title) else POLICY
    for policy, pattern in ways:
        # of the name of the call only the first mention counts
        for m in list(compiled(pattern).finditer(text))[: 1 if pattern is AI_CALL else None]:
            quote = snippet(text, m.start(), len(m[0]))
            if not _has(CODE, quote):
                return policy, quote
    return None


def premiere(text: str) -> tuple[str, str] | None:
    """The rule, if all statements agree; a premiere that is no condition is none."""
    found = []
    for rule, pattern in PREMIERE:
        for m in compiled(pattern).finditer(text):
            quote = snippet(text, m.start(), len(m[0]))
            if _has(CODE, quote) or _has(ONE_CATEGORY, quote) or (rule != "none" and not _has(PREMIERE_RULE, quote)):
                continue
            found.append(("none" if rule != "none" and _has(PREMIERE_NOT, quote) else rule, quote))
    return found[0] if len({r for r, _ in found}) == 1 else None


def eligibility(text: str) -> list[str]:
    out: list[str] = []
    for pattern in ELIGIBLE:
        if m := compiled(pattern).search(text):
            phrase = _one_line(m[0])[:160]
            if len(phrase) >= 12 and phrase not in out:
                out.append(phrase)
    return out[:4]


def read_date(text: str) -> tuple[date, int, int] | None:
    """(date, start, end) by the first form whose first match is a real date."""
    for pattern, order in DATE_FORMS:
        m = compiled(pattern).search(text)
        if not m:
            continue
        if order:
            year, month, day = (m[i] for i in order)
        elif int(m[1]) > 12 or int(m[2]) > 12:
            year, month, day = (m[3], m[2], m[1]) if int(m[1]) > 12 else (m[3], m[1], m[2])
        else:
            continue
        try:
            return date(int(year), int(month) if month.isdigit() else MONTH_OF[month.lower()], int(day)), m.start(), m.end()
        except (ValueError, KeyError):
            continue
    return None


def title_words(title: str | None) -> list[str]:
    return [w for w in re.split(r"[\W_]+", fold(title or "")) if len(w) >= 4 and not re.fullmatch("[0-9]+", w) and w not in TITLE_STOP]


def tiers(text: str) -> list[tuple[date, int, int, int, int]]:
    """(date, start, end, start of the list, end of the list) of the tiers that follow one another right after a heading."""
    out = []
    for heading in compiled(TIER_HEADING).finditer(text):
        at, own = heading.end(), []
        while len(own) < 8 and (label := compiled(TIER).match(text, at)):
            hit = read_date(text[label.end() : label.end() + 26])
            if not hit or hit[1]:
                break
            at = label.end() + hit[2]
            own.append((hit[0], label.start(), at))
        out += [(*tier, heading.start(), at) for tier in own]
    return out


def closing_dates(text: str, title: str | None = None) -> list[tuple[date, int, int, bool]]:
    """(date, start, end, near the title) of the dates beside a closing word, and of the tiers of a list."""
    wanted, out = title_words(title), []
    mentions = lambda some: any(w in fold(some) for w in wanted)
    for word in compiled(CLOSING).finditer(text):
        after = text[word.end() : word.end() + 110].split("\n", 1)[0]
        hit, start = read_date(after), word.start()
        if hit and not any(_has(FOREIGN, x) for x in (after[: hit[1]], after[hit[2] : hit[2] + 16])):
            day, end = hit[0], word.end() + hit[2]
        else:  # right before the word
            before = text[max(0, word.start() - 40) : word.start()]
            hit = read_date(before)
            if not hit or len(re.sub(r"[\s·•|:\-–—()]", "", before[hit[2] :])) > 6:
                continue
            day, start, end = hit[0], word.start() - len(before) + hit[1], word.end()
        if _has(CODE, _one_line(text[start:end])):
            continue
        above = text[max(0, start - 150) : start]
        lines = [x.strip() for x in above.split("\n") if x.strip()][-2:]
        # right under the name of another call
        if wanted and any(len(x) <= 60 and _has(CALL_NAME, x) and not _has(CLOSING, x) and not mentions(x) for x in lines):
            continue
        out.append((day, start, end, mentions(above + text[start:end] + text[end:].split("\n", 1)[0])))
    out += [(day, start, end, mentions(text[max(0, first - 150) : last + 50])) for day, start, end, first, last in tiers(text)]
    return out


def deadline(text: str, now: date, title: str | None = None) -> tuple[date, str, bool] | None:
    """(date, quote, whether there are several): the latest coming one, else the latest; dates near the title come first."""
    found = closing_dates(text, title)
    found = [x for x in found if x[3]] or found
    best = [x for x in found if x[0] >= now - timedelta(days=1)] or found
    if not best:
        return None
    day, start, end, _ = max(best, key=lambda x: x[0])
    return day, _one_line(text[start:end]), len(found) > 1


# --- columns --------------------------------------------------------------------

_FIELDS = [
    ("deadline", "date"), ("deadline_quote", "string"), ("several_dates", "boolean"), ("max_minutes", "int"), ("min_minutes", "int"), ("runtime_quote", "string"), ("fee", "double"), ("fee_currency", "string"), ("fee_quote", "string"),
    ("ai_policy", "string"), ("ai_quote", "string"), ("premiere", "string"), ("premiere_quote", "string"), ("eligibility", "array<string>"),
]


def read(text: str, title: str | None, now: date, asked: int = 63) -> tuple:
    """All fields of a text; ``asked`` has a bit for each gate that it met."""
    bit = {name: asked >> i & 1 for i, name in enumerate(GATES)}
    nothing = (None, None, None)
    day = bit["deadline"] and deadline(text, now, title) or nothing
    most = bit["runtime"] and runtime(text) or nothing
    cost = bit["fee"] and fee(text) or nothing
    policy = bit["ai_policy"] and ai_policy(text, title) or nothing[:2]
    rule = bit["premiere"] and premiere(text) or nothing[:2]
    return (*day, *most, *cost, *policy, *rule, (bit["eligibility"] and eligibility(text)) or [])


def asked_for(text: Column) -> Column:
    """A bit for each field whose gate the text meets."""
    return sum((F.when(text.rlike(p), 1 << i).otherwise(0) for i, p in enumerate(GATES.values())), F.lit(0))


def decision_fields(now: date, most: int | None = None) -> Callable[[Column, Column], Column]:
    """A function of a text and a title column that gives all fields as a struct; ``most`` characters of a text are read, all if None."""

    @F.pandas_udf(", ".join(f"{n} {t}" for n, t in _FIELDS))
    def extract(texts: pd.Series, titles: pd.Series, asked: pd.Series) -> pd.DataFrame:
        rows = [read(t or "", title, now, int(a)) for t, title, a in zip(texts, titles, asked, strict=True)]
        out = pd.DataFrame(rows, columns=[n for n, _ in _FIELDS], dtype=object)
        return out.astype({"max_minutes": "Int32", "min_minutes": "Int32", "several_dates": "boolean"})

    def of(text: Column, title: Column) -> Column:
        body = F.coalesce(text if most is None else F.substring(text, 1, most), F.lit(""))
        asked = asked_for(body)
        return extract(F.when(asked > 0, body), title, asked)

    return of


def filled(known: dict[str, Column], facts: Column) -> Column:
    """Known facts, and what ``facts`` adds where they are empty; ``filled`` names what was added.

    ``known``: deadline (date), deadline_status, max_minutes, fee, fee_currency, ai_policy, premiere (text) and
    eligibility (array). A rolling deadline is not replaced; an unclear AI policy is.
    """
    empty = {
        "deadline": known["deadline"].isNull() & ~known["deadline_status"].eqNullSafe("rolling"),
        "max_minutes": known["max_minutes"].isNull(),
        "fee": known["fee"].isNull(),
        "ai_policy": F.coalesce(known["ai_policy"], F.lit("")).isin("", "unclear"),
        "eligibility": F.coalesce(F.size(known["eligibility"]), F.lit(0)) <= 0,
        "premiere": F.coalesce(known["premiere"], F.lit("")) == "",
    }
    stated = {k: facts[k].isNotNull() for k in empty} | {"eligibility": F.size(facts["eligibility"]) > 0}
    new = {k: empty[k] & stated[k] for k in empty}
    out = [F.when(new[k], facts[k]).otherwise(known[k]).alias(k) for k in empty]
    out += [F.when(new["fee"], facts["fee_currency"]).otherwise(known["fee_currency"]).alias("fee_currency"), F.when(new["deadline"], "confirmed").otherwise(known["deadline_status"]).alias("deadline_status")]
    names = F.filter(F.array(*[F.when(new[k], k) for k in empty]), lambda x: x.isNotNull())
    return F.struct(*out, names.alias("filled"))
