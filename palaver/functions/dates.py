"""Dates in text: finding, reading against an anchor, formatting.

The grammar: ISO dates; Month D with optional ordinal ending and year; M/D with optional year; weekdays, also with
"next"; today, tomorrow, this morning, next week, next month, end of week; in N days or weeks. A date without a year and
a weekday mean the next occurrence after the anchor. Anything else, or a null anchor where one is needed, is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions import rules as R
from palaver.functions import text as T

_M = "|".join(R.MONTHS)
_D = "|".join(R.DAYS)
# The alternatives in order; edges are word edges of ASCII words, which all of them are.
PHRASE = (
    r"\d{4}-\d{2}-\d{2}"
    rf"|(?:{_M})\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?"
    r"|\d{1,2}/\d{1,2}(?:/\d{4})?"
    rf"|(?:next\s+)?(?:{_D})"
    r"|today|tomorrow|this morning|next week|next month|end of week"
    r"|in\s+\d{1,3}\s+(?:days?|weeks?)"
)
FIND = rf"(?i)(?<![A-Za-z0-9_/\-])({PHRASE})(?![A-Za-z0-9_/\-])"

FORMATS = {"human": "EEEE, MMMM dd, yyyy 'at' hh:mm a", "iso": "yyyy-MM-dd HH:mm", "date_only": "yyyy-MM-dd", "utc": "yyyy-MM-dd'T'HH:mm:ssXXX"}


def find_dates(c: Column | str) -> Column:
    """Array of the date phrases in text order."""
    return F.regexp_extract_all(T.col(c), F.lit(FIND), F.lit(1))


def _next(month: Column, day: Column, anchor: Column) -> Column:
    """The next such day after or on the anchor's date."""
    this = F.try_make_timestamp(F.year(anchor), month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    after = F.try_make_timestamp(F.year(anchor) + 1, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.when(this >= anchor, this).otherwise(after)


def parse_date(phrase: Column | str, anchor_ts: Column | str) -> Column:
    """DATE of the first phrase of the grammar in the text, read against the anchor."""
    p, anchor = F.lower(F.trim(T.col(phrase))), F.to_date(T.col(anchor_ts))
    g = lambda rx, n: F.regexp_extract(p, rx, n)
    iso = r"(\d{4}-\d{2}-\d{2})"
    named = rf"({_M})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?"
    slash = r"(?<!\d)(\d{1,2})/(\d{1,2})(?:/(\d{4}))?"
    month = F.array_position(F.array(*[F.lit(m) for m in R.MONTHS]), g(named, 1)).cast("int")

    def with_year(m: Column, d: Column, y: Column) -> Column:
        year = y.try_cast("int")
        return F.when(year.isNotNull(), F.try_make_timestamp(year, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")).otherwise(_next(m, d, anchor))

    day = rf"({_D})"
    n = F.regexp_extract(p, r"in\s+(\d{1,3})\s+(days?|weeks?)", 1).try_cast("int")
    unit = F.regexp_extract(p, r"in\s+(\d{1,3})\s+(days?|weeks?)", 2)
    return (
        F.when(F.regexp_like(p, F.lit(iso)), g(iso, 1).try_cast("date"))
        .when(F.regexp_like(p, F.lit(named)), with_year(month, g(named, 2).try_cast("int"), g(named, 3)))
        .when(F.regexp_like(p, F.lit(slash)), with_year(g(slash, 1).try_cast("int"), g(slash, 2).try_cast("int"), g(slash, 3)))
        .when(F.regexp_like(p, F.lit(day)), _weekday(anchor, g(day, 1)))
        .when(F.contains(p, F.lit("today")) | F.contains(p, F.lit("this morning")), anchor)
        .when(F.contains(p, F.lit("tomorrow")), F.date_add(anchor, 1))
        .when(F.contains(p, F.lit("next week")), F.date_add(anchor, 7))
        .when(F.contains(p, F.lit("next month")), F.add_months(anchor, 1))
        .when(F.contains(p, F.lit("end of week")), _weekday(F.date_sub(anchor, 1), F.lit("friday")))
        .when(n.isNotNull(), F.date_add(anchor, n * F.when(F.startswith(unit, F.lit("week")), 7).otherwise(1)))
    )


def _weekday(anchor: Column, name: Column) -> Column:
    """The first such weekday after the anchor."""
    want = F.array_position(F.array(*[F.lit(d) for d in R.DAYS]), name).cast("int")
    return F.date_add(anchor, (F.pmod(want - (F.weekday(anchor) + 1) + 6, F.lit(7)) + 1).cast("int"))


def format_datetime(ts: Column | str, fmt: str = "human") -> Column:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    return F.date_format(T.col(ts), FORMATS[fmt])


def normalize_in_text(c: Column | str, anchor_ts: Column | str) -> Column:
    """The text with every date phrase that can be read replaced by its ISO date; the rest unchanged, null stays null."""
    t = T.col(c)
    phrases, parts = F.regexp_extract_all(t, F.lit(FIND), F.lit(1)), F.split(t, FIND)
    iso = F.transform(phrases, lambda p: F.coalesce(F.date_format(parse_date(p, anchor_ts), FORMATS["date_only"]), p))
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(iso, i), F.lit("")))), "")


def in_range(c: Column | str, start: Column | None = None, end: Column | None = None) -> Column:
    """Whether a date lies within the bounds, both inclusive; a missing bound is open, a null date is outside."""
    x = T.col(c)
    ok = x.isNotNull()
    ok = ok if start is None else ok & (x >= start)
    return F.coalesce(ok if end is None else ok & (x <= end), F.lit(False))


def earliest(c: Column | str) -> Column:
    """Aggregate: the first date, null if there is none."""
    return F.min(T.col(c))


def latest(c: Column | str) -> Column:
    return F.max(T.col(c))
