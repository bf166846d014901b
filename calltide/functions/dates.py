"""Date functions as column expressions; the current time is always a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names in seven languages (fixed values).
MONTHS = {
    1: "january jan gennaio enero janvier januar janeiro januari",
    2: "february feb febbraio febrero février fevrier februar fevereiro februari",
    3: "march mar marzo mars märz marz março marco maart",
    4: "april apr aprile abril avril",
    5: "may maggio mayo mai maio mei",
    6: "june jun giugno junio juin juni junho",
    7: "july jul luglio julio juillet juli julho",
    8: "august aug agosto août aout augustus",
    9: "september sep sept settembre septiembre septembre setembro",
    10: "october oct ottobre octubre octobre oktober outubro",
    11: "november nov novembre noviembre novembro",
    12: "december dec dicembre diciembre décembre decembre dezember dezembro",
}
MONTH_OF = {name: n for n, names in MONTHS.items() for name in names.split()}
NAMES = "|".join(sorted(MONTH_OF, key=lambda x: (-len(x), x)))
WORD = "(?<![A-Za-z0-9_])"
#: The forms of a date: pattern and the groups of year, month and day; the last has two readings.
FORMS = [
    (rf"{WORD}(20[0-9]{{2}})[-./]([0-9]{{1,2}})[-./]([0-9]{{1,2}})(?![A-Za-z0-9_])", [(1, 2, 3)]),
    (r"(20[0-9]{2})\s*[年년]\s*([0-9]{1,2})\s*[月월]\s*([0-9]{1,2})", [(1, 2, 3)]),
    (rf"(?i){WORD}([0-9]{{1,2}})(?:st|nd|rd|th|er|º|°)?\.?\s+(?:de\s+)?({NAMES})\.?,?\s+(?:de\s+)?(20[0-9]{{2}})(?![A-Za-z0-9_])", [(3, 2, 1)]),
    (rf"(?i){WORD}({NAMES})\.?\s+([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+(20[0-9]{{2}})(?![A-Za-z0-9_])", [(3, 1, 2)]),
    (rf"{WORD}([0-9]{{1,2}})[/.]([0-9]{{1,2}})[/.](20[0-9]{{2}})(?![A-Za-z0-9_])", [(3, 2, 1), (3, 1, 2)]),
]


def month_number(c: Column) -> Column:
    """The month of a number or a name."""
    names = F.create_map(*[F.lit(x) for pair in MONTH_OF.items() for x in pair])
    return F.coalesce(F.try_to_number(c, F.lit("99")).cast("int"), F.try_element_at(names, F.lower(c)))


def valid_date(year: Column, month: Column, day: Column) -> Column:
    """The date, null if there is none such (31 February)."""
    text = F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), text.try_cast("date"))


def mentions(text: Column) -> Column:
    """All dates that a text mentions, sorted, each once; d/m/y is read both ways."""
    found = []

    def reader(p: str, y: int, m: int, d: int) -> Callable[[Column], Column]:
        return lambda x: valid_date(F.regexp_extract(x, p, y), month_number(F.regexp_extract(x, p, m)), F.regexp_extract(x, p, d))

    for pattern, readings in FORMS:
        whole = F.regexp_extract_all(text, F.lit(f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})"), 1)
        found += [F.transform(whole, reader(pattern, *r)) for r in readings]
    dates = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.array(*found)))))
    return F.when(text.rlike("20[0-9]{2}"), dates).otherwise(F.array().cast("array<date>"))  # each form has such a year


def upcoming(text: Column, now: Column, past: int = 3, future: int = 548) -> Column:
    """The mentioned dates from ``past`` days ago to ``future`` days ahead."""
    day = F.to_date(now)
    return F.filter(mentions(text), lambda d: (d >= F.date_sub(day, past)) & (d <= F.date_add(day, future)))


def mentions_upcoming_year(text: Column, now: Column) -> Column:
    """This or the next year stands in the text other than in a copyright line."""
    y = F.year(now)
    bare = F.regexp_replace(text, r"(?i)(?:©|\(c\)|copyright|&copy;)[^0-9]{0,10}20[0-9]{2}", " ")
    return bare.contains(y.cast("string")) | bare.contains((y + 1).cast("string"))


def normalize_deadline(text: Column, now: Column) -> Column:
    """A deadline as a time (UTC): a bare date ends its day; a time with offset is itself; a textual date needs day, month and year; from last year to ten years ahead."""
    t = F.trim(text)
    bare = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(t, F.lit(" 23:59:59")).try_cast("timestamp_ntz"))
    full = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}"), F.regexp_replace(F.regexp_replace(t, "T", " "), r"(?:\.[0-9]+)?Z$", "").try_cast("timestamp_ntz"))
    first = F.try_element_at(mentions(t), F.lit(1))
    textual = F.when(first.isNotNull(), F.concat(first.cast("string"), F.lit(" 23:59:59")).try_cast("timestamp_ntz"))
    out = F.coalesce(bare, full, textual)
    return F.when(F.year(out).between(F.year(now) - 1, F.year(now) + 10), out)


def monday_of_brief(day: Column) -> Column:
    """The Monday of a brief: the day itself if it is one, else the next."""
    return F.next_day(F.date_sub(day, 1), "MON")


def countdown(deadline: Column, now: Column) -> Column:
    """(days, tone): days rounded up; urgent to 7, soon to 14, passed below 0."""
    days = F.ceil((F.unix_micros(deadline.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / F.lit(86_400_000_000.0)).cast("int")
    return F.struct(days.alias("days"), F.when(days < 0, "passed").when(days <= 7, "urgent").when(days <= 14, "soon").when(days.isNotNull(), "later").otherwise("none").alias("tone"))


def year_of(*texts: Column) -> Column:
    """The first year (1900 to 2099) in the texts, in their order."""
    one = lambda c: F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1)
    return F.coalesce(*[F.when(one(c) != "", one(c).cast("int")) for c in texts])


def edition_of(title: Column) -> Column:
    """The ordinal of `Nth edition`."""
    x = F.regexp_extract(title, r"(?i)(?<![A-Za-z0-9_])([0-9]{1,3}(?:st|nd|rd|th))\s+(?:annual\s+)?edition(?![A-Za-z0-9_])", 1)
    return F.when(x != "", x)


def staggered(key: Column, now: Column, days: int, salt: str) -> Column:
    """A first check within ``days``, by the hash of a key."""
    from .scoring import hash_fraction

    micros = F.floor(hash_fraction(key, salt) * F.lit(days * 86_400_000)).cast("bigint") * 1000
    return now + F.make_dt_interval(secs=(micros / F.lit(1_000_000)).cast("decimal(18,6)"))


def explicit_time(text: Column) -> Column:
    """A time that names its offset, in UTC; null without one."""
    ok = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(?::[0-9]{2})?(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})$")
    return F.when(ok, F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz"))


def day_month_year(text: Column) -> Column:
    """dd.mm.yyyy"""
    p = r"^\s*([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})\s*$"
    return F.when(text.rlike(p), valid_date(F.regexp_extract(text, p, 3), F.regexp_extract(text, p, 2), F.regexp_extract(text, p, 1)))


def next_cutoff(days: Column, today: Column) -> Column:
    """The first date not before today."""
    return F.array_min(F.filter(days, lambda d: d >= today))
