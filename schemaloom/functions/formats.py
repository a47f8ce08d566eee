"""String and number formats as boolean Column functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of the formats.
TIME = r"([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?"
OFFSET = r"([Zz]|[+-]\d\d:\d\d)"
IPV4 = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}"
LABEL = r"[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
H16 = r"[0-9A-Fa-f]{1,4}"


def _date(v: Column) -> Column:
    return v.rlike(r"^\d{4}-\d\d-\d\d$") & F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).isNotNull()


def _date_time(v: Column) -> Column:
    return v.rlike(rf"^\d{{4}}-\d\d-\d\d[Tt]{TIME}{OFFSET}$") & _date(F.substring(v, 1, 10))


def _ipv6(v: Column) -> Column:
    full = v.rlike(rf"^({H16}:){{7}}{H16}$") | v.rlike(rf"^({H16}:){{6}}{IPV4}$")
    groups = F.size(F.filter(F.split(v, ":"), lambda g: g != ""))
    short = v.rlike(rf"^(({H16}:)*{H16})?::(({H16}:)*{H16})?$") & (groups <= 7)
    mixed = v.rlike(rf"^::({H16}:){{0,5}}{IPV4}$")
    return full | short | mixed


def _email(v: Column) -> Column:
    at, dot = F.instr(v, "@"), F.length(v) - F.instr(F.reverse(v), ".") + 1
    return v.rlike(r"^[^\x00-\x20]+$") & (at > 1) & (F.instr(v, ".") > 0) & (dot >= at + 2) & (dot < F.length(v))


def _uri(v: Column) -> Column:
    """What a WHATWG URL parser takes: any scheme, and for special ones a host without forbidden characters and a port of digits."""
    special = v.rlike(r"^(?i)(https?|ftp|wss?):")
    host = v.rlike(r"^(?i)[a-z]+:[/\\]*([^/?#@\s]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#@:\s<>^|%\[\]]+)(:\d{0,5})?([/?#\\]|$)")
    return v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & (~special | host)


def _uri_reference(v: Column) -> Column:
    """An absolute URI, or what a URL parser takes relative to an https one: no blank, and a host without forbidden characters after two slashes."""
    scheme, slashes = v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), v.rlike(r"^[/\\]{2}")
    relative = F.when(scheme, v.rlike(r"^(?i)https:(?![/\\]{2})")).when(slashes, _uri(F.concat(F.lit("https:"), v))).otherwise(True)
    return (v == "") | _uri(v) | (~v.contains(" ") & relative)


def _balanced(v: Column) -> Column:
    """Whether braces are closed in turn."""
    step = lambda depth, c: F.when(depth < 0, depth).when(c == "{", depth + 1).otherwise(depth - 1)
    braces = F.filter(F.split(F.regexp_replace(v, r"[^{}]", ""), ""), lambda c: c != "")
    return F.aggregate(braces, F.lit(0), step) == 0


def _idn_host(v: Column) -> Column:
    """What stands for a host, and maybe more, after https://."""
    return _uri(F.concat(F.lit("https://"), v))


def _pattern(p: str) -> Callable[[Column], Column]:
    return lambda v: v.rlike(p)


STRING_FORMATS: dict[str, Callable[[Column], Column]] = {
    "date": _date,
    "date-time": _date_time,
    "time": _pattern(rf"^{TIME}$"),
    "duration": _pattern(r"^P(?!$)(\d+(\.\d+)?[A-Za-z])*(T(\d+(\.\d+)?[A-Za-z])+)?$"),
    "email": _email,
    "idn-email": lambda v: v.rlike(r"^[^\x00-\x20@]+@[^\x00-\x20@]+$") & _idn_host(F.substring_index(v, "@", -1)),
    "hostname": lambda v: v.rlike(rf"^{LABEL}(\.{LABEL})*$") & (F.length(v) <= 253),
    "idn-hostname": _idn_host,
    "ipv4": _pattern(rf"^{IPV4}$"),
    "ipv6": _ipv6,
    "uri": _uri,
    "iri": _uri,
    "uri-reference": _uri_reference,
    "iri-reference": _uri_reference,
    "uri-template": lambda v: _uri_reference(v) & _balanced(v),
    "uuid": _pattern(r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[1-8][0-9A-Fa-f]{3}-[89ABab][0-9A-Fa-f]{3}-[0-9A-Fa-f]{12}$"),
    "json-pointer": _pattern(r"^(/([^~/]|~[01])*)*$"),
    "byte": lambda v: (F.length(v) % 4 == 0) & v.rlike(r"^[A-Za-z0-9+/]*={0,2}$"),
    "binary": lambda v: (F.length(v) % 2 == 0) & v.rlike(r"^[0-9A-Fa-f]+$"),
}
NUMBER_FORMATS: dict[str, Callable[[Column], Column]] = {
    "int32": lambda x: (x == F.floor(x)) & (x >= -(2.0**31)) & (x <= 2.0**31 - 1),
    "int64": lambda x: (x == F.floor(x)) & (F.abs(x) <= 2.0**53 - 1),
    "float": lambda x: x.cast("float").cast("double") == x,
    "double": lambda x: F.abs(x) < float("inf"),
}


#: What Unicode-mode ECMAScript knows behind a backslash, but for syntax characters and longer forms.
_ESCAPED = re.compile(r"[dDwWsSbBnrtvf0\^$.*+?()\[\]{}|/\\\-]|[1-9]\d*|c[A-Za-z]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\}|k<[A-Za-z_$][\w$]*>|[pP]\{[\w=]+\}")


def is_regex(pattern: str | None) -> bool:
    """Whether a pattern is one of ECMAScript in Unicode mode: its own syntax is checked first, then the rest of it is compiled."""
    if pattern is None:
        return False
    out, i, inside, repeated = [], 0, False, 0  # repeated: 1 after a quantifier, 2 after a lazy one
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            m = _ESCAPED.match(pattern, i + 1)
            if not m or m[0] == "-" and not inside:
                return False
            e = m[0]
            out.append("\\w" if e[0] in "pP" else "a" if e[0] in "cxu/" else f"(?P={e[2:-1]})" if e[0] == "k" else "\\" + e)
            i, repeated = m.end(), 0
            continue
        if inside:
            out.append("\\[" if c == "[" else c)
            inside = c != "]"
            i += 1
            continue
        times = re.match(r"\{\d+(?:,\d*)?\}|[*+?]", pattern[i:])
        if times:
            if repeated == 2 or repeated == 1 and times[0] != "?":
                return False
            repeated += 1
            out.append(times[0])
            i += times.end()
            continue
        repeated = 0
        if c in "{}]":
            return False
        if pattern.startswith(("[]", "[^]"), i):  # nothing and anything
            out.append("a")
            i = pattern.index("]", i) + 1
            continue
        if pattern.startswith("(?", i):
            m = re.match(r"\(\?(?::|=|!|<=|<!|<([A-Za-z_$][\w$]*)>)", pattern[i:])
            if not m:
                return False
            out.append(f"(?P<{m[1].replace('$', '_')}>" if m[1] else m[0])
            i += m.end()
            continue
        inside = c == "["
        out.append(c)
        i += 1
    try:
        re.compile("".join(out))
    except (re.error, OverflowError):
        return False
    return not inside


def _regex_compiles(v: Column) -> Column:
    """A pattern can only be tried by compiling it, so this one format is a vectorised Python function."""
    return F.pandas_udf(lambda s: s.map(is_regex), "boolean")(v)


def strict_json(text: Column) -> Column:
    """JSON text as VARIANT, null for anything else. The parser stops at the end of a value, so the text is also tried
    within an array and within an object, where what follows a value can't go unseen."""
    alone = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")) == 1
    inside = F.try_parse_json(F.concat(F.lit('{"":'), text, F.lit("}"))).isNotNull()
    return F.when(alone & inside, F.try_parse_json(text))


class Formats:
    """Formats by name: built-in ones, and those that a user adds as Column functions."""

    def __init__(self):
        self._own: dict[str, tuple[str, Callable[[Column], Column]]] = {}

    def set(self, name: str, check: Callable[[Column], Column], kind: str = "string") -> None:
        self._own[name] = (kind, check)

    @property
    def changed(self) -> bool:
        """Whether the user added formats."""
        return bool(self._own)

    def has(self, name: str) -> bool:
        return self.get(name) is not None

    def get(self, name: str) -> tuple[str, Callable[[Column], Column]] | None:
        """("string" or "number", check), or None: an unknown format passes."""
        if name in self._own:
            return self._own[name]
        if name in STRING_FORMATS:
            return "string", STRING_FORMATS[name]
        if name in NUMBER_FORMATS:
            return "number", NUMBER_FORMATS[name]
        return ("string", _regex_compiles) if name == "regex" else None

    @staticmethod
    def builtin() -> list[str]:
        return [*STRING_FORMATS, *NUMBER_FORMATS, "regex"]
