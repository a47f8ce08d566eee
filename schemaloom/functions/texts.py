"""Texts as characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def characters(text: Column) -> Column:
    """The code points of a text, as an array of strings."""
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), 1)


def in_hexadecimal(text: Column, which: str) -> Column:
    """A text whose characters of a class (a pattern) stand as \\u and four digits."""
    each = lambda c: F.when(c.rlike(which), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(c)), 4, "0"))).otherwise(c)
    return F.when(text.rlike(which), F.array_join(F.transform(characters(text), each), "")).otherwise(text)
