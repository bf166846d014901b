"""Text identity functions as column expressions.

Accents are folded with one ``translate`` table, made from the Unicode
decompositions of single characters, so that keys need no Python worker.
Word boundaries are written out as look-arounds on ASCII word characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An ASCII word boundary before and after.
B, E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Words that name no series (fixed values).
SERIES_STOP = "the festival film films international intl of and de du des la le les di del della der die das und award awards competition edition annual fest".split()
#: Words that cannot tie a page to a call (fixed values).
GENERIC_WORDS = (
    "film films festival festivals international competition competitions contest contests award awards call calls open submission submissions "
    "short shorts deadline deadlines entry entries the for and grant grants fund prize program programme edition annual new world "
    "global best guide every apply applications project projects"
).split()
#: Headings and deadline tiers that are not names (fixed pattern).
GENERIC_TITLE = (
    r"(?i)^(?:(?:early\s*-?\s*bird|earlybird|regular|late|final|extended|standard|last)?\s*deadlines?\b.*|(?:open\s+)?call\s+for\s+(?:film\s+|short\s+film\s+)?(?:entries|submissions|projects|applications|films|works)"
    r"|open\s+calls?|submissions?(?:\s+open)?|entries|apply(?:\s+now)?|how\s+to\s+(?:apply|submit)|registration(?:\s+open)?|workshops?|rules(?:\s+(?:and|&)\s+regulations)?|convocatoria(?:\s+abierta)?|bases|bando|iscrizioni)$"
)
#: Entities that are decoded in pages, and further ones in titles (fixed values).
ENTITIES = [("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&nbsp;", " ")]
NAMED = {
    "mdash": "—", "ndash": "–", "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "laquo": "«", "raquo": "»", "middot": "·", "bull": "•",
    "eacute": "é", "egrave": "è", "agrave": "à", "ntilde": "ñ", "ccedil": "ç", "uuml": "ü", "ouml": "ö", "auml": "ä", "oacute": "ó", "iacute": "í", "aacute": "á", "deg": "°",
}
#: Site chrome before and after a name, announcements without a name and before one (fixed patterns).
CHROME_BEFORE = r"(?iu)^(?:home|homepage|accueil|inicio|startseite)\s*[-–—|:»]\s*|^welcome\s+to\s+(?:the\s+)?"
CHROME_AFTER = r"(?iu)\s*[-–—|:»]\s*(?:home|homepage|accueil|inicio|startseite)$|\s*[-–—|:]\s*(?:(?:final|last|early|late)\s+)?deadline(?![A-Za-z0-9_]).*$"
ANNOUNCEMENT = r"(?iu)^(?:(?:the\s+)?(?:call\s+for\s+(?:entries|submissions|applications|projects)|submissions?|entries|applications?|registrations?)(?:\s+(?:for\s+)?(?:19|20)[0-9][0-9])?\s+(?:is|are)\s+(?:now\s+)?open(?:ed)?\s*[!.]*)$"
ANNOUNCED = r"(?iu)^(?:submissions?|entries|applications?|registrations?)\s+(?:for|to)\s+(?:the\s+)?(.+?)\s+(?:is|are)\s+(?:now\s+)?open(?:ed)?\s*[!.]*$"
ANNOUNCING = (
    r"(?iu)^(?:(?:inscripciones|convocatoria)\s+abiertas?\s+(?:para|del?)\s+(?:el|la|los|las)?\s*|iscrizioni\s+aperte\s+(?:per|al|alla)?\s*(?:il|la)?\s*|inscriptions?\s+ouvertes?\s+(?:pour|au|à\s+la)?\s*(?:le|la)?\s*"
    r"|(?:submissions?|entries|applications?)\s+(?:are\s+)?(?:now\s+)?open\s+(?:for|to)\s+(?:the\s+)?|call\s+for\s+(?:entries|submissions)\s+)"
)
#: Page labels before and after a name, letter-spaced capitals, names of a category only, section headings (fixed patterns).
LABEL_BEFORE = (
    r"(?iu)^(?:rules\s+(?:and|&)\s+regulations|regulations?|rules|call\s+for\s+(?:submissions?|entries|applications?|projects)|submissions?|submit(?:\s+your\s+(?:film|work))?|apply(?:\s+now)?|open\s+call|entry\s+form|application\s+form)(?:\s*[-–—:|]\s*|$)"
    r"|^(?:submit|apply)\s+(?:to|for)\s+|^submit\s+your\s+(?=\S)"
)
LABEL_AFTER = r"(?iu)(?:\s*[-–—:|]\s*|\s+)(?:submissions?(?:\s+form)?|call\s+for\s+(?:entries|submissions)|entry\s+form|regulations|rules)$"
LETTER_SPACED = r"(?:\s+\p{Lu}){4,}$"
CATEGORY_ONLY = (
    r"(?iu)^(?:(?:international|national|genre|short|feature|student|youth|documentary|animation|animated|music\s+video|experimental|main|official|european|local|regional|online|screenplay|screenwriting|script|pitch(?:ing)?|vertical|ai|short\s+film|poster|trailer)\s+)*"
    r"(?:competition|contest|category|section|programme|program|prize|award|selection)s?$"
)
SECTION = (
    r"(?iu)^(?:the\s+)?(?:(?:festival|event|edition|year)\s+)?(?:in\s+(?:numbers|figures|brief)|at\s+a\s+glance|facts\s+(?:and|&)\s+figures|key\s+(?:facts|figures|numbers)|statistics|highlights|about(?:\s+us)?|our\s+(?:history|story|team|mission)"
    r"|history|team|partners|sponsors|press(?:\s+room)?|newsletter|contacts?|faqs?|news)$"
)


@cache
def fold_table() -> tuple[str, str]:
    """Characters whose compatibility decomposition is one character and marks, and that character."""
    pairs = []
    for i in range(0xA0, 0x2E80):
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(i):
            pairs.append((chr(i), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Without accents and other marks."""
    return F.regexp_replace(F.translate(c, *fold_table()), r"\p{M}+", "")


def squeeze(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s ﻿]+", " "))


def clean(c: Column, most: int = 300) -> Column:
    return F.substring(squeeze(F.coalesce(c.cast("string"), F.lit(""))), 1, most)


def _words_only(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"[^a-z0-9\p{L}\p{N}]+", " "))


def identity_text(c: Column) -> Column:
    """For keys: folded, lower case, without years and numbered editions, letters and digits only."""
    t = F.lower(fold(clean(c, 500)))
    t = F.regexp_replace(t, f"{B}(?:19|20)[0-9]{{2}}{E}", " ")
    t = F.regexp_replace(t, rf"{B}[0-9]{{1,3}}(?:st|nd|rd|th|a|e|o)?\s+(?:annual\s+)?edition{E}", " ")
    return _words_only(t)


def match_text(c: Column) -> Column:
    """For matching: folded, lower case, & as and, without apostrophes, letters and digits only."""
    t = F.lower(fold(F.coalesce(c.cast("string"), F.lit(""))))
    return _words_only(F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), "[’']", ""))


def event_series(c: Column) -> Column:
    """``match_text`` without years, ordinals, edition numbers and call words."""
    t = match_text(c)
    for p in (r"(?:19|20)[0-9]{2}", r"[0-9]{1,3}(?:st|nd|rd|th)", r"(?:annual )?edition [0-9]{1,3}", r"(?:open call|call for (?:entries|films|projects)|applications?|submissions?)"):
        t = F.regexp_replace(t, f"{B}{p}{E}", " ")
    return squeeze(t)


def series_key(c: Column) -> Column:
    """A key that is the same for all editions: without years, ordinals and filler words."""
    t = fold(F.lower(F.coalesce(c.cast("string"), F.lit(""))))
    t = F.regexp_replace(t, f"{B}(?:19|20)[0-9]{{2}}{E}", " ")
    t = F.regexp_replace(t, f"{B}[0-9]+(?:st|nd|rd|th|e|er|a|o|º|ª)?{E}", " ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")
    return squeeze(F.regexp_replace(t, f"{B}(?:{'|'.join(SERIES_STOP)}){E}", " "))


def slug(c: Column, most: int = 72) -> Column:
    return F.substring(F.regexp_replace(identity_text(c), " +", "-"), 1, most)


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct words of a normalised text with ``least`` letters or more."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda x: F.length(x) >= least))


def distinctive(c: Column) -> Column:
    """Words that name something: three letters or more, no numbers, none of the generic ones."""
    words = F.split(fold(F.lower(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda x: (F.length(x) >= 3) & ~x.rlike("^[0-9]+$") & ~x.isin(GENERIC_WORDS))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over those of the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    n = F.size(a) + F.size(b)
    return F.when(n > 0, F.size(F.array_intersect(a, b)) * F.lit(2.0) / n).otherwise(F.lit(0.0))


def initials(c: Column) -> Column:
    t = F.regexp_replace(fold(F.lower(F.coalesce(c, F.lit("")))), f"{B}(?:19|20)[0-9]{{2}}{E}", " ")
    return F.array_join(F.transform(F.filter(F.split(t, "[^a-z0-9]+"), lambda x: x != ""), lambda x: F.substring(x, 1, 1)), "")


def names_host(label: Column, words: Column, short: Column) -> Column:
    """A site's label has one of the words, or the (three or more) initials."""
    return F.exists(words, lambda t: label.contains(t)) | ((F.length(short) >= 3) & label.contains(short))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it."""
    return F.transform(F.array(c), f)[0]


def numeric(c: Column) -> Column:
    """Decimal and hexadecimal entities as their characters; those of no character stay away."""
    pattern = r"(?i)&#(x[0-9a-f]+|[0-9]+);"

    def char(code: Column) -> Column:
        digits = F.when(code.rlike("^[xX]"), F.substring(code, 2, 8)).otherwise(F.hex(code.try_cast("bigint")))
        return F.coalesce(F.decode(F.unhex(F.lpad(F.substring(digits, -8, 8), 8, "0")), "UTF-32"), F.lit(""))

    def joined(t: Column) -> Column:
        between, codes = F.split(t, pattern), F.regexp_extract_all(t, F.lit(pattern), 1)
        return F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(char(F.get(codes, i)), F.lit("")))), "")

    return bound(c, lambda t: F.when(t.contains("&#"), joined(t)).otherwise(t))


def decode(c: Column) -> Column:
    """The entities of pages."""
    for pattern, text in ENTITIES:
        c = F.regexp_replace(c, pattern, text)
    return numeric(c)


def decode_name(c: Column) -> Column:
    """The entities of titles: those of pages in lower case, and the named ones of letters and signs in any."""
    for pattern, text in ENTITIES:
        c = F.regexp_replace(c, pattern.replace("(?i)", "").replace("&#39;", "&#0?39;"), text)

    def names(t: Column) -> Column:
        pattern = r"(?i)&([a-z]+);"
        between, found = F.split(t, pattern), F.regexp_extract_all(t, F.lit(pattern), 1)
        table = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
        sign = lambda name: F.coalesce(table[F.lower(name)], F.concat(F.lit("&"), name, F.lit(";")), F.lit(""))
        return F.array_join(F.transform(between, lambda x, i: F.concat(x, sign(F.get(found, i)))), "")

    return numeric(bound(c, lambda t: F.when(t.rlike("&[A-Za-z]"), names(t)).otherwise(t)))


def is_generic_title(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), rf"{B}(?:19|20)[0-9]{{2}}(?:\s*[–-]\s*(?:19|20)?[0-9]{{2}})?{E}", " ")
    t = squeeze(F.regexp_replace(t, r"[|:–—\-!.,()\[\]\"'«»]+", " "))
    return (t == "") | t.rlike(GENERIC_TITLE)


def clean_organizer(c: Column) -> Column:
    return F.trim(squeeze(F.split(decode_name(F.coalesce(c.cast("string"), F.lit(""))), r" \| ")[0]))


def _cleaned(raw: Column, org: Column) -> Column:
    """A title of one line without chrome, announcements and a closing organizer (already clean)."""

    def named(t: Column) -> Column:
        inner = F.regexp_extract(t, ANNOUNCED, 1)
        return F.when(t.rlike(ANNOUNCEMENT), "").when(inner != "", F.trim(inner)).otherwise(F.trim(F.regexp_replace(t, ANNOUNCING, "")))

    def without(t: Column) -> Column:
        before = F.rtrim(F.substring(t, F.lit(1), F.length(t) - F.length(org)))
        cut = F.trim(F.regexp_extract(before, r"(?s)^(.*?)\s+[-–—]$", 1))
        own = (F.length(org) > 2) & F.lower(t).endswith(F.lower(org)) & F.substring(t, F.length(t) - F.length(org), F.lit(1)).rlike(r"\s") & (F.length(cut) >= 6)
        return F.when(own, cut).otherwise(t)

    t = F.trim(F.split(F.regexp_replace(raw, CHROME_BEFORE, ""), r" \| ")[0])
    return bound(bound(F.trim(F.regexp_replace(t, CHROME_AFTER, "")), named), without)


def _line(c: Column) -> Column:
    return squeeze(decode_name(F.coalesce(c.cast("string"), F.lit(""))))


def clean_title(c: Column, organizer: Column) -> Column:
    """A title without entities, site names, chrome, announcements and a closing organizer."""
    return bound(F.struct(_line(c).alias("raw"), clean_organizer(organizer).alias("org")), lambda x: _cleaned(x["raw"], x["org"]))


def public_title(c: Column, organizer: Column) -> Column:
    """(title, unresolved): the name under which a record is public.

    Page labels are taken off; what names nothing by itself (a category, a heading, a label) takes
    the organizer's name, and stays unresolved where no usable organizer is known.
    """

    def named(x: Column) -> Column:
        cleaned = F.trim(F.regexp_replace(_cleaned(x["raw"], x["org"]), LETTER_SPACED, ""))
        title = bound(cleaned, lambda t: F.struct(t.alias("cleaned"), F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, LABEL_BEFORE, "")), LABEL_AFTER, "")).alias("title")))
        return F.struct(x["raw"].alias("raw"), x["org"].alias("org"), title["cleaned"].alias("cleaned"), title["title"].alias("title"))

    def judged(x: Column) -> Column:
        title, org, raw = x["title"], x["org"], F.trim(F.split(x["raw"], r" \| ")[0])
        usable = (F.length(org) > 2) & ~org.rlike(r"(?i)^[\w-]+\.[a-z.]{2,}$") & ~org.rlike("(?i)^unknown")
        bare = (title == "") | F.regexp_replace(title, r"\s+(?:19|20)[0-9][0-9]$", "").rlike(CATEGORY_ONLY) | (F.size(distinctive(title)) == 0)
        label = (title != raw) & ~F.lower(raw).startswith(F.lower(title))
        said = F.exists(distinctive(org), lambda w: F.lower(title).contains(w))
        both = F.concat_ws(" – ", org, F.when(title != "", title))
        section = title.rlike(SECTION)
        name = F.when(section & usable, org).when(section, title).when(~bare & label & usable & ~said, both).when(~bare, title).when(~usable, F.coalesce(F.when(title != "", title), x["cleaned"])).otherwise(both)
        return F.struct(name.alias("title"), (~usable & (section | bare)).alias("unresolved"))

    return bound(bound(F.struct(_line(c).alias("raw"), clean_organizer(organizer).alias("org")), named), judged)


def adds_information(organizer: Column, title: Column) -> Column:
    """The organizer has a word that the title has not."""
    split = lambda c: F.filter(F.split(match_text(c), " "), lambda x: x != "")
    return F.size(F.array_except(split(organizer), split(title))) > 0


def contains_evidence(page: Column, quote: Column) -> Column:
    """The quote (four characters or more) stands in the page, whatever the case and white space."""
    q = F.lower(clean(quote, 500))
    return (F.length(q) >= 4) & F.lower(squeeze(F.coalesce(page, F.lit("")))).contains(q)


def quote_around(text: Column, pattern: str, before: int = 40, most: int = 180) -> Column:
    """The first match with up to ``before`` characters on either side."""
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(F.trim(F.substring(text, start, F.length(F.regexp_extract(text, f"({pattern})", 1)) + 2 * before)), 1, most))


def lead_name(title: Column) -> Column:
    """The name in quotes, else the head of a news title."""
    quoted = F.regexp_extract(title, r"[\"“«]([^\"”»]{4,80})[\"”»]", 1)
    return F.when(quoted != "", quoted).otherwise(F.trim(F.split(title, r" [-–—|:] ")[0]))
