"""Dates in free notation, and what is derived from them."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The period of interest, how dates are written and where they stand in a text.
FIRST, LAST = "2019-01-01", "2026-12-31"
#: Tried in this order, with the shape a text must have (the parser is laxer than the notation).
FORMATS = [
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"), ("yyyy-M", r"^\d{4}-\d{1,2}$"), ("yyyy/M", r"^\d{4}/\d{1,2}$"),
    ("MMMM d, yyyy", r"(?i)^[a-z]+\s+\d{1,2},\s+\d{4}$"), ("MMM d, yyyy", r"(?i)^[a-z]{3}\s+\d{1,2},\s+\d{4}$"),
    ("d MMMM yyyy", r"(?i)^\d{1,2}\s+[a-z]+\s+\d{4}$"), ("d MMM yyyy", r"(?i)^\d{1,2}\s+[a-z]{3}\s+\d{4}$"), ("yyyy", r"^\d{4}$"),
]
ISO, YEAR_MONTH, YEAR = r"\b(\d{4})-(\d{2})-(\d{2})\b", r"\b(\d{4})[/-](\d{2})\b", r"\b(20\d{2})\b"
RANGE = r"(?i)(\d{4}[/-]\d{2}[/-]\d{2})\s*(?:→|->|to|\s)\s*(\d{4}[/-]\d{2}[/-]\d{2})"


def parse_date(c: Column) -> Column:
    """A date by the first notation that fits, else by the first full date, month or year in the text; null if none is one."""
    text = strip(c)
    spaced = F.initcap(F.regexp_replace(text, r"\s+", " "))
    whole = [F.when(text.rlike(shape), F.try_to_date(spaced, pattern)) for pattern, shape in FORMATS]
    part = lambda p, k: F.regexp_extract(text, p, k)
    inside = [
        F.when(text.rlike(ISO), F.try_to_date(F.regexp_extract(text, ISO, 0), "yyyy-MM-dd")),
        F.when(text.rlike(YEAR_MONTH), F.try_to_date(F.concat_ws("-", part(YEAR_MONTH, 1), part(YEAR_MONTH, 2), F.lit("01")), "yyyy-MM-dd")),
        F.when(text.rlike(YEAR), F.try_to_date(F.concat(part(YEAR, 1), F.lit("-01-01")), "yyyy-MM-dd")),
    ]
    return F.coalesce(*whole, *inside)


def parse_range(c: Column) -> tuple[Column, Column]:
    """(start, end) of a range, or (date, null)."""
    ranged = c.rlike(RANGE)
    start = F.when(ranged, parse_date(F.regexp_extract(c, RANGE, 1))).otherwise(parse_date(c))
    return start, F.when(ranged, parse_date(F.regexp_extract(c, RANGE, 2)))


def in_window(d: Column) -> Column:
    return F.coalesce(d.between(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")), F.lit(False))


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def compact_date(c: Column) -> Column:
    """YYYYMMDD with dashes; anything else as it is."""
    return F.when(c.rlike(r"^\d{8}$"), F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(c)


def epoch_date(seconds: Column) -> Column:
    """Date of UTC seconds as text; 0 and null are empty. Years beyond 9999 have no sign, as in SQL."""
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")
    day = F.ltrim(day, F.lit("+"))
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "").otherwise(day)


def signal_hash(drug: Column, source: Column, day: Column, extra: Column) -> Column:
    parts = [F.coalesce(x, F.lit("")) for x in (drug, source, day, extra)]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("|"), p)
    return F.substring(F.sha1(joined), 1, 20)


# The notations of review dates.
_NAMES = ["%Y-%m-%d", "%Y/%m/%d", "%Y-%m", "%Y/%m", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%Y"]


def parse_date_text(text: str) -> dt.date | None:
    """parse_date of a Python string, for use in parsers."""
    text = text.strip()
    for name in _NAMES:
        try:
            return dt.datetime.strptime(text, name).date()  # noqa: DTZ007
        except ValueError:
            continue
    for pattern in (ISO, YEAR_MONTH, YEAR):
        if found := re.search(pattern, text):
            year, month, day = (*map(int, found.groups()), 1, 1)[:3]
            try:
                return dt.date(year, month, day)
            except ValueError:
                continue
    return None
