"""Article XML: titles, abstracts, subject terms and dates, in Arrow batches; malformed articles yield nothing."""

from __future__ import annotations

import datetime as dt
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import parse_date_text

ARTICLE = "abstract string, title string, mesh array<string>"
_DATED = ("PubDate", "ArticleDate", "DateCompleted", "DateRevised")


def article(content: str | None) -> dict:
    """Text of each element is what stands before its first child."""
    if not content:
        return {"abstract": "", "title": "", "mesh": []}
    try:
        root = ElementTree.fromstring((content or "").encode())
    except ElementTree.ParseError:
        return {"abstract": "", "title": "", "mesh": []}
    text = lambda tag: " ".join(n.text or "" for n in root.iter(tag))
    return {"abstract": text("AbstractText"), "title": text("ArticleTitle"), "mesh": [n.text.strip().lower() for n in root.iter("DescriptorName") if n.text]}


def _month(text: str) -> int:
    try:
        return int(text)
    except ValueError:
        pass
    try:
        return dt.datetime.strptime(text[:3], "%b").month  # noqa: DTZ007
    except ValueError:
        return 1


def article_dates(content: str | None) -> list[dt.date]:
    try:
        root = ElementTree.fromstring((content or "").encode())
    except ElementTree.ParseError:
        return []
    found = []
    for tag in _DATED:
        for node in root.iter(tag):
            year, day = node.findtext("Year"), node.findtext("Day") or "1"
            try:
                if year:
                    found.append(dt.date(int(year), _month(node.findtext("Month") or "1"), max(1, int(day) if day.isdigit() else 1)))
            except ValueError:
                continue
    found += [d for n in root.iter("MedlineDate") if (d := parse_date_text(n.text or ""))]
    return found


def articles(content: Column) -> Column:
    @F.pandas_udf(ARTICLE)
    def parsed(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article(x) for x in s], columns=["abstract", "title", "mesh"])

    return parsed(content)


def dates(content: Column) -> Column:
    @F.pandas_udf("array<date>")
    def parsed(s: pd.Series) -> pd.Series:
        return s.map(article_dates)

    return parsed(content)
