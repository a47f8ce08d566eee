"""Secret scans by assignment-aware lexing.

The lexer reads source and configuration syntax as name-literal pairs: assignments, keys, elements, calls, named
values of elements and indented blocks. It propagates constants through names and concatenations, and scores each
literal by how sensitive the name is that it ends up in. A name means its nearest definition before, or else the
nearest after; chains of names are followed to their end, whatever their length. The name of a target goes down to each
literal below it: in lists, sets, calls, conversions, brackets over several lines, triple quotes, and after tags.

Defined results: a null or empty text has no spans; a very long text is read whole, in time that grows with its
length; the same document given twice gives two equal rows; of names defined more than once each use has its own
definition; a literal that is reached twice is one span; concatenations of more than ``LITERAL`` characters are judged by their longest part; columns besides the id and the text are ignored, so their
names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, read

KINDS = ("assign", "access", "hex", "lexed")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

# Words of a target name and how much they speak for a secret.
NAME_WEIGHTS = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "pass": 2.5, "pw": 2.5, "cred": 2.5, "creds": 2.5, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 3.0,
    "credentials": 3.0, "auth": 1.5, "bearer": 2.5, "private": 1.0, "access": 1.0, "key": 1.5, "client": 0.5, "api": 1.0, "signing": 1.0,
    "encryption": 1.0, "salt": 1.5, "cookie": 1.0, "session": 1.0, "webhook": 1.0, "dsn": 1.5, "mnemonic": 3.0,
}
# Words of a name that say the literal is about a secret, not one itself.
NAME_DAMPERS = {
    "count", "length", "len", "size", "type", "name", "field", "url", "uri", "path", "file", "header", "prefix", "suffix", "label",
    "hint", "placeholder", "max", "min", "limit", "expiry", "ttl", "format", "regex", "pattern", "enabled", "required", "public",
}
#: What a literal with blanks lacks, but for names of secrets that are made of words.
BLANKS = 3.0
# Literals that stand for a secret to be filled in.
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|change_me|example|sample|dummy|todo|none|null|true|false|undefined|your[_-].*|<.*>|\$\{.*\}|%.*%|\{\{.*\}\})$")

#: Concatenations of more characters than this aren't built but judged by their longest part.
LITERAL = 4096
#: What stands before an operator, read backwards: a type, an index, a quote, the name.
BEFORE = re.compile(r"""[ \t]*+(?:[A-Za-z0-9_.<>]*[A-Za-z_][ \t]*+:(?!:)[ \t]*+)?(?:\](?:[0-9A-Za-z_]*+\[)?)?["'`]?([A-Za-z0-9_$.\-]++)""")
OPERATOR = re.compile(r":=|=>|==+|!=|<=|>=|\+=|=|:(?!:|//)")
TERM = re.compile(r"""[ \t]*(?:[rbuf]?"((?:[^"\\\n]|\\.)*+)"|[rbuf]?'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|\$\{?([A-Za-z_][A-Za-z0-9_]*+)\}?|([A-Za-z_$][A-Za-z0-9_$]*+(?:\.[A-Za-z0-9_$]++)*)(?![(\[])|([A-Za-z0-9+/_\-.=]{8,}+))""")
#: A bare literal is the longest run of these, unless it is a name as a whole.
RUN = re.compile(r"[ \t]*([A-Za-z0-9+/_.=-]{8,}+)")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
PLUS = re.compile(r"[ \t]*(?:\+|\.\.|\|\|)(?=[ \t]*[\"'`A-Za-z_$])")
REFERENCE = re.compile(r"\$\{?([A-Za-z_][A-Za-z0-9_]*)\}?$")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)(?:\s[^<>]*+)?>([^<>]*+)</")
TAG = re.compile(r"<[A-Za-z][^<>]*+>")
ATTRIBUTE = re.compile(r"""([A-Za-z_][A-Za-z0-9_.:-]*+)\s*+=\s*+(?:"([^"<>]*+)"|'([^'<>]*+)')""")
CALL = re.compile(r"""\([ \t]*+(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)')(?:[ \t]*+,[ \t]*+(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'))?""")
CALLED = re.compile(r"[ \t]*+([A-Za-z0-9_$.]++)")
#: First words of a function's name that say that it takes what it is called after.
SETTERS = {"set", "with", "use", "add", "put", "assign", "store", "login"}
#: A key whose value is the indented block under it.
INDENTED = re.compile(r"""(?m)^([ \t]*+)(?:- )?["']?([A-Za-z_][A-Za-z0-9_.\-]*+)["']?[ \t]*+:[ \t]*+[|>][+\-0-9]*+[ \t]*+\n((?:\1[ \t]++[^\s][^\n]*+(?:\n|\Z)|[ \t]*+\n)++)""")


#: What nested values are read by: literals of all kinds, brackets, operators, ends of statements, words.
TOKEN = re.compile(
    r"""\"{3}(?P<a>(?:[^"\\]|\\.|"(?!""))*+)\"{3}|\'{3}(?P<b>(?:[^'\\]|\\.|'(?!''))*+)\'{3}|"(?P<c>(?:[^"\\\n]|\\.)*+)"|(?<![A-Za-z0-9])'(?P<d>(?:[^'\\\n]|\\.)*+)'|`(?P<e>[^`\n]*+)`"""
    r"""|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<op>:=|=>|==+|!=|<=|>=|\+=|=|:(?!:|//))|(?P<end>[\n;,])|(?P<plus>\+|\.\.?)|(?P<space>[ \t\r]++)|(?P<word>[^\s"'`()\[\]{}:=;,+]++)""",
    re.DOTALL,
)
CLOSING = {"(": ")", "[": "]", "{": "}"}


class Pair(NamedTuple):
    """name = terms; each term is (kind, value, start, end) with kind "text" or "name".

    ``other``: the terms if a bare literal begins with a name; they count where all their names have constants.
    """

    name: str
    terms: tuple[tuple[str, str, int, int], ...]
    other: tuple[tuple[str, str, int, int], ...] = ()


def _run(text: str, at: int) -> re.Match | None:
    """The bare literal at a place, if there is one that isn't a name as a whole."""
    m = RUN.match(text, at)
    if not m or IDENTIFIER.fullmatch(m[1]):
        return None
    if m[1][-1] in "+=" and IDENTIFIER.fullmatch(m[1][:-1]) and (quote := text[m.end() : m.end() + 1]) and quote in "\"'`":
        line = text.rfind("\n", 0, at) + 1
        if text.count(quote, line, at) % 2 == 0:  # the quote opens: an operator after a name
            return None
    return m


def _terms(text: str, at: int, whole: bool) -> tuple[list[tuple[str, str, int, int]], int, int]:
    """The terms at a place, where they end, and where the last bare literal taken whole ends."""
    terms, run = [], 0
    while True:
        if whole and (m := _run(text, at)):
            terms.append(("text", m[1], m.start(1), m.end(1)))
            run = m.end()
        elif m := TERM.match(text, at):
            k = m.lastindex
            ref = REFERENCE.match(m[k]) if k < 4 else None
            terms.append(("name", ref[1], m.start(k), m.end(k)) if ref else ("name" if k in (4, 5) else "text", m[k], m.start(k), m.end(k)))
        else:
            break
        at = m.end()
        plus = PLUS.match(text, at)
        if not plus:
            break
        at = plus.end()
    return terms, at, run


def _value(text: str, start: int, end: int) -> tuple[tuple[str, str, int, int], ...]:
    """The term that a stretch of text is, without blanks around it; none if it is blank."""
    literal = text[start:end].strip()
    if not literal:
        return ()
    start += text[start:end].index(literal)
    ref = REFERENCE.match(literal)
    return (("name", ref[1], start, start + len(literal)) if ref else ("text", literal, start, start + len(literal)),)


def _assignments(text: str) -> list[tuple[int, Pair]]:
    pairs, end, taken, told, back = [], 0, 0, False, text[::-1]
    for op in OPERATOR.finditer(text):
        if op.start() < end or op[0] in ("==", "===", "!=", "<=", ">="):
            continue
        m = BEFORE.match(back, len(text) - op.start())
        name = m[1][::-1].lstrip("0123456789.-$") if m else ""
        if not name:
            continue
        # within a bare literal, only the first sensitive name takes the rest of it whole: others are covered by it
        whole = op.end() >= taken or not told and sensitivity(name) > 0
        terms, at, run = _terms(text, op.end(), whole)
        other = []
        if run:
            told = sensitivity(name) > 0
            taken = run
            other = [x for x in [_terms(text, op.end(), False)[0]] if any(k == "name" for k, *_ in x)]
        if terms:
            pairs.append((op.start(), Pair(name, tuple(terms), tuple(other[0]) if other else ())))
            end = at if terms[0][0] == "text" and not other else op.end()
    return pairs


def _elements(text: str) -> list[tuple[int, Pair]]:
    """<name>literal</name>, and the value of <... name="name" value="literal">."""
    pairs = [(m.start(2), Pair(m[1], _value(text, m.start(2), m.end(2)))) for m in ELEMENT.finditer(text)]
    for tag in TAG.finditer(text):
        own = {m[1].lower(): m for m in ATTRIBUTE.finditer(text, tag.start(), tag.end())}
        name = own.get("name") or own.get("key")
        if name and (value := own.get("value")):
            k = 2 if value[2] is not None else 3
            pairs.append((value.start(k), Pair(name[2] or name[3] or "", _value(text, value.start(k), value.end(k)))))
    return pairs


def _calls(text: str) -> list[tuple[int, Pair]]:
    """f("name", "literal"), and set_name("literal")."""
    pairs, back = [], text[::-1]
    for m in CALL.finditer(text):
        first = 1 if m[1] is not None else 2
        second = 3 if m[3] is not None else 4
        if m[second] is not None:
            pairs.append((m.start(second), Pair(m[first], (("text", m[second], m.start(second), m.end(second)),))))
        elif f := CALLED.match(back, len(text) - m.start()):
            name = f[1][::-1].rpartition(".")[2]
            if (WORD.findall(name) or [""])[0].lower() in SETTERS:
                pairs.append((m.start(first), Pair(name, (("text", m[first], m.start(first), m.end(first)),))))
    return pairs


def _indented(text: str) -> list[tuple[int, Pair]]:
    """The block under a key: its lines joined, without those that only mark where a key begins or ends."""
    pairs = []
    for m in INDENTED.finditer(text):
        lines = [x.strip() for x in m[3].split("\n")]
        terms = _value(text, m.start(3), m.end(3))
        literal = "".join(x for x in lines if not x.startswith("-----"))
        if terms:
            pairs.append((m.start(3), Pair(m[2], (("text", literal, *terms[0][2:]),))))
    return pairs


def _nested(text: str) -> list[tuple[int, Pair]]:
    """Literals below a target: items of lists and sets, arguments of calls and conversions, literals in brackets over several
    lines, in triple quotes, and after a tag. The innermost target counts; keys aren't values; neighbours are one literal."""
    tokens = [m for m in TOKEN.finditer(text) if m.lastgroup != "space"]
    partner: dict[int, int] = {}
    stack: list[int] = []
    for i, m in enumerate(tokens):
        if m.lastgroup == "open":
            stack.append(i)
        elif m.lastgroup == "close" and stack and CLOSING[tokens[stack[-1]][0]] == m[0]:
            partner[stack[-1]] = i
            partner[i] = stack.pop()
    back, pairs = text[::-1], []
    frames: list[tuple[str | None, str | None]] = []  # (target of the bracket, target that waited before it)
    waiting, combined, run, near = None, False, [], None  # the target before a value, literals that are one, and the token before

    def told() -> None:
        if run:
            name, terms = run[0][0], tuple(x for _, x in run)
            pairs.append((terms[0][2], Pair(name, terms)))
            run.clear()

    for i, m in enumerate(tokens):
        kind = m.lastgroup
        if kind in "abcde":
            after = tokens[i + 1] if i + 1 < len(tokens) else None
            is_key = after is not None and after.lastgroup == "op" and after[0] in (":", "=>", "=")
            name = waiting or (frames[-1][0] if frames else None)
            plain = waiting and near is not None and near.lastgroup == "op" and kind not in "ab" and not combined  # an assignment tells these
            if name and not is_key and not plain:
                if run and (run[0][0] != name or near.lastgroup not in ("a", "b", "c", "d", "e", "plus", "end") or near[0] in ",;"):
                    told()
                run.append((name, ("text", m[kind], m.start(kind), m.end(kind))))
            else:
                told()
        elif kind == "open":
            told()
            if i in partner:
                frames.append((waiting or (frames[-1][0] if frames else None), waiting))
            waiting = None
        elif kind == "close":
            told()
            if i in partner and frames:
                waiting = frames.pop()[1]
        elif kind == "op":
            told()
            found = BEFORE.match(back, len(text) - m.start()) if m[0] in (":", "=", ":=", "=>", "+=") else None
            name = found[1][::-1].lstrip("0123456789.-$") if found else ""
            outer = frames[-1][0] if frames else None
            combined = bool(name and outer and sensitivity(name) <= 0)  # a key below a target has both names
            if name and sensitivity(name) > 0:
                waiting = name
            elif combined:
                waiting = f"{outer}.{name}"
            elif m[0] != "=" or not name:  # after a type, the name before it still waits
                waiting = None
        elif kind == "end":
            if m[0] != "\n" or not frames:
                told()
            waiting = None if m[0] != "\n" or not frames else waiting
        elif kind == "word":
            told()
        near = m if kind != "end" or m[0] != "\n" else near if run else m
    told()
    return [(at, p) for at, p in pairs if p.name]


def lex(text: str) -> list[Pair]:
    """The name-literal and name-name pairs of a text, in order."""
    pairs = _assignments(text)
    if "</" in text or "/>" in text:
        pairs += _elements(text)
    if "(" in text:
        pairs += _calls(text)
    if any(c in text for c in "\"'`"):
        pairs += _nested(text)
    if "|" in text or ">" in text:
        pairs += _indented(text)
    return [p for _, p in sorted(pairs) if p.terms]


def resolved(pairs: list[Pair]) -> list[tuple[str, str, int, int]]:
    """(target name, constant, start, end): constants followed through names; the span is of the literal itself."""
    places: dict[str, list[int]] = {}
    for i, p in enumerate(pairs):
        places.setdefault(p.name, []).append(i)

    def meant(i: int, name: str) -> int:
        """The pair that defines a name where pair i uses it: the nearest before, else after; i itself if there is no other."""
        at = places[name]
        k = bisect_left(at, i)
        if k:
            return at[k - 1]
        k += at[k] == i
        return at[k] if k < len(at) else i

    known: list[tuple[str, int, int] | None] = [None] * len(pairs)

    def constant(i: int, terms: tuple[tuple[str, str, int, int], ...], strict: bool = False) -> tuple[str, int, int] | None:
        parts: list[tuple[str, int, int]] = []
        for kind, value, start, end in terms:
            if kind == "text":
                parts.append((value, start, end))
            elif value in places:
                got = known[meant(i, value)]
                if got is None:
                    return None
                parts.append(got)
            elif len(terms) == 1 and not strict:  # a bare word: configuration files don't quote
                return value, start, end
            else:
                return None
        if len(parts) == 1:
            return parts[0]
        longest = max(parts, key=lambda x: (len(x[0]), -x[1]))
        if sum(len(x[0]) for x in parts) > LITERAL:
            return longest
        return "".join(x[0] for x in parts), longest[1], longest[2]

    # each pair after those that it is made of; what is in a cycle comes last and has no constant
    needs = [{meant(i, v) for k, v, *_ in (*p.terms, *p.other) if k == "name" and v in places} for i, p in enumerate(pairs)]
    users: dict[int, list[int]] = {}
    for i, js in enumerate(needs):
        for j in js:
            users.setdefault(j, []).append(i)
    left = [len(js) for js in needs]
    ready = [i for i, n in enumerate(left) if not n]
    for i in ready:
        for user in users.get(i, ()):
            left[user] -= 1
            if not left[user]:
                ready.append(user)
    ready += [i for i, n in enumerate(left) if n]
    out = []
    for i in ready:
        p = pairs[i]
        both = [c for c in (p.other and constant(i, p.other, True), constant(i, p.terms)) if c]
        known[i] = both[0] if both else None
        out += [(p.name, *c) for c in both]
    return out


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def sensitivity(name: str) -> float:
    words = [w.lower() for w in WORD.findall(name)]
    score = sum(sorted((NAME_WEIGHTS.get(w, 0.0) for w in set(words)), reverse=True)[:3])
    return score - 2.0 * sum(w in NAME_DAMPERS for w in set(words[-2:]))


def shape(literal: str) -> tuple[float, bool] | None:
    """What a literal's shape says for a secret, and whether it has blanks; None where it can't be one."""
    if len(literal) < 8 or PLACEHOLDERS.match(literal):
        return None
    classes = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in literal)
    return 0.6 * (classes - 1) + 0.5 * (entropy(literal) - 2.5) - 3.0, bool(re.search(r"\s", literal.strip()))


def score(name: str, literal: str, shapes: dict[str, tuple[float, bool] | None] | None = None) -> float:
    """Above 0: a secret. The target name gives the prior, the literal's shape the evidence; ``shapes`` keeps what was found of literals."""
    prior = sensitivity(name)
    if prior <= 0:
        return -1.0
    shapes = {} if shapes is None else shapes
    if literal not in shapes:
        shapes[literal] = shape(literal)
    if shapes[literal] is None:
        return -1.0
    evidence, blanks = shapes[literal]
    if blanks and not {"passphrase", "mnemonic"} & {w.lower() for w in WORD.findall(name)}:
        prior -= BLANKS  # most literals with blanks are about a secret
    return prior + evidence if prior > 0 else -1.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with what the lexer adds outside of them."""
    text = text or ""
    base = base_spans(text)
    if not any(c in text for c in ":=<("):
        return base, base
    starts, ends = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
    shapes: dict[str, tuple[float, bool] | None] = {}

    def within(s: int, e: int) -> bool:
        at = bisect_right(starts, s)
        return at > 0 and ends[at - 1] >= e

    added = {(s, 3, e) for name, literal, s, e in resolved(lex(text)) if score(name, literal, shapes) > 0 and not within(s, e)}
    return base, sorted([*base, *added])


def told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: spans as array<struct<kind, start, end, value>> in code points, end exclusive, with base apart."""

    def each(columns):
        ids, texts = columns
        rows = []
        for text in texts:
            base, every = spans(text)
            said = lambda x: [{"kind": KINDS[k], "start": s, "end": e, "value": (text or "")[s:e]} for s, k, e in x]
            rows.append((said(base), said(every)))
        return [ids, [r[0] for r in rows], [r[1] for r in rows]]

    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<kind:string,start:int,end:int,value:string>>"
    return map_rows(docs.select(id_col, text_col), each, f"`{id_col}` {kind}, base_spans {span}, spans {span}")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, from the spans that the operator found."""
    from pyspark.sql import functions as F

    def joined(c):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(c, kind):
        return F.size(F.filter(c, lambda x: x["kind"] == kind)).cast("long")

    base, every = F.col("base_spans"), F.col("spans")
    return found.select(
        "doc_id",
        *(count(base, k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        count(every, "lexed").alias("n_lexed"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(read(spark, sf_dir, "documents")))
