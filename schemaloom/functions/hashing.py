"""Content hashes of JSON values that equal those of the reference format, bit for bit."""

from __future__ import annotations

import json
import math
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import characters

# Start and multiplier of the hash, and what a structural hash leaves out.
START = 2166136261
PRIME = 16777619.0
IGNORED = ("$id", "title", "description", "examples", "$comment")


def number_text(x: float | int) -> str:
    """A number as JavaScript prints it."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int) and abs(x) < 2**53:
        return str(x)
    x = float(x)
    if math.isnan(x) or math.isinf(x):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return f"{Decimal(repr(x + 0.0)):f}".removesuffix(".0")  # -0 is 0
    mantissa, _, exponent = repr(x).partition("e")
    if exponent:
        e = int(exponent)
        if -7 < e < 21:
            return f"{x:.{max(0, len(mantissa.replace('.', '').lstrip('-')) - 1 - e)}f}"
        return f"{mantissa.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"
    return repr(x)


def text(value: Any, sort: bool = True) -> str:
    """JSON text with keys in order (array indices first, as JavaScript enumerates them)."""
    if value is None or isinstance(value, (bool, int, float)):
        return "null" if value is None else number_text(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be")) if sort else list(value)
        index = sorted((k for k in keys if k.isascii() and k.isdigit() and str(int(k)) == k and int(k) < 2**32 - 1), key=int)
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{text(value[k], sort)}" for k in [*index, *(k for k in keys if k not in set(index))]) + "}"
    return "[" + ",".join(text(v, sort) for v in value) + "]"


def hash_text(s: str) -> str:
    """The 32-bit hash of a text by UTF-16 units: an exclusive or in 32 bits, a product in double precision.

    A unit that starts a surrogate pair counts as the whole code point, and the one after it counts again.
    """
    units = s.encode("utf-16-be", "surrogatepass")
    codes = [int.from_bytes(units[i : i + 2]) for i in range(0, len(units), 2)]
    h = START
    for i, c in enumerate(codes):
        if 0xD800 <= c < 0xDC00 and i + 1 < len(codes) and 0xDC00 <= codes[i + 1] < 0xE000:
            c = 0x10000 + ((c - 0xD800) << 10) + codes[i + 1] - 0xDC00
        x = (h ^ c) & 0xFFFFFFFF
        signed = x - (1 << 32) if x >= 1 << 31 else x
        h = int(float(signed) * PRIME) & 0xFFFFFFFF
    return f"{h:x}"


def hash_column(text: Column) -> Column:
    """``hash_text`` of a column, on Spark's own functions."""
    point = F.transform(characters(text), lambda c: F.ascii(c).cast("bigint"))
    units = F.flatten(F.transform(point, lambda c: F.when(c > 0xFFFF, F.array(c, F.lit(0xDC00) + (c - 0x10000) % 1024)).otherwise(F.array(c))))

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(c)
        return (F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("double") * F.lit(PRIME)).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))

    return F.lower(F.hex(F.aggregate(units, F.lit(START).cast("bigint"), step)))


def value_hash(value: Any) -> str:
    return hash_text(text(value))


def structural_text(schema: Any) -> str:
    """A schema without what says nothing of its structure, as sorted JSON."""
    def strip(v):
        if isinstance(v, dict):
            return {k: strip(x) for k, x in v.items() if k not in IGNORED}
        return [strip(x) for x in v] if isinstance(v, list) else v

    return text(strip(schema))


def structural_hash(schema: Any) -> str:
    return hash_text(structural_text(schema))
