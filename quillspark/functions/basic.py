"""Small helpers for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda variable isn't inlined where it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines_of(text: Column) -> Column:
    """Lines of a text without their ends; a last empty line doesn't count."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "\r?\n$", ""), "\r?\n"))


def blank(col: Column) -> Column:
    return F.regexp_replace(col, "[\\s\\x0B\\x85\\xA0\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+", "") == ""
