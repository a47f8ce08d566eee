"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(x: Column) -> Column:
    """A double as JavaScript prints it: the shortest digits, with an exponent from 1e21 on and below 1e-6."""
    size, whole = F.abs(x), x == F.rint(x)
    plain = F.when(size < 1, x.try_cast("decimal(38,30)").cast("string")).otherwise(x.try_cast("decimal(38,18)").cast("string"))
    power = F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.0)?E-", "e-"), r"(\.0)?E", "e+")
    return (
        F.when(whole & (size < 1e15), x.try_cast("bigint").cast("string"))
        .when(whole & (size < 1e21), x.try_cast("decimal(38,0)").cast("string"))
        .when((size >= 1e-6) & (size < 1e21), F.regexp_replace(plain, "0+$", ""))
        .otherwise(power)
    )


def decimal_text(x: Column) -> Column:
    """A decimal in full, without zeros that say nothing."""
    s = x.cast("string")
    return F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
