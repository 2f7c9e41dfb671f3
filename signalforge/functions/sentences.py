"""Sentences of a text by rules, as column expressions: no model, no Python worker.

A sentence ends with . ! or ? and up to two closing quotes or brackets, before white space that no lower-case letter follows; not after an
abbreviation. It ends too at an empty line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Words whose full stop ends no sentence.
ABBREVIATIONS = ["Dr", "Mr", "Mrs", "Ms", "Prof", "St", "vs", "e.g", "i.e", "approx", "Fig", "No"]
#: How much of a text is looked at sentence by sentence. Fixed value.
LENGTH = 2000


def _either(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


BREAK = rf"(?<=[.!?][\"')\]]{{0,2}})(?<!(?:^|[^A-Za-z])(?:{_either(ABBREVIATIONS)})\.[\"')\]]{{0,2}})\s+(?=[^\p{{Ll}}\s])|\n\s*\n"


def sentences(text: Column, length: int | None = LENGTH) -> Column:
    """The sentences of the first `length` characters (None: of all), trimmed, without empty ones; a null text has none."""
    seen = text if length is None else F.substring(text, 1, length)
    parts = F.filter(F.transform(F.split(seen, BREAK), strip), lambda s: s != "")
    return F.coalesce(parts, F.array().cast("array<string>"))
