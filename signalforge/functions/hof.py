"""Helpers for array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once a row however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def strings(values) -> Column:
    """A literal array of strings; parsed at once, which is much faster than one literal by another."""
    return F.expr(f"cast(array({_quoted(values)}) as array<string>)")


def literal_map(table: dict[str, str]) -> Column:
    return F.expr(f"map({_quoted(x for kv in table.items() for x in kv)})")


def mapped(table: dict[str, str], term: Column) -> Column:
    """table's entry for the term, or the term itself."""
    return F.coalesce(literal_map(table)[term], term)
