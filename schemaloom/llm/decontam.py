"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces; whatever lies within k edits of it holds
one piece unchanged. Pieces are found exactly by an Aho-Corasick automaton, and each hit is verified around its
place with Myers' bit-parallel distance.

Texts and items are compared in lower case with single spaces between words. Where the items, a query set, have
``block_bytes`` at most, their automaton is broadcast. The pieces of more are told by hashes of their first characters:
one pass over the texts finds the places whose hash is in a filter, and a join by hash brings them together with the
items that they may belong to. Short items of such a benchmark are searched block by block.

Defined results: a null or empty text or item matches nothing; very long texts are searched whole; of places of an
equal distance the first is given; an item of fewer than ``min_chars`` normalised characters
is found only unchanged and as whole words (scripts without spaces have no such bounds); equal items all match; a null item id is kept as null; repeated
documents give repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_rows, map_rows, read, stored
from .neardup import mixed
from .suffix import FILTER_KEYS, bloom_of

ERROR_SHARE = 0.05
MIN_CHARS = 40
BLOCK_BYTES = 8 << 20
#: Code points of scripts that are written without spaces, from Thai to Myanmar, Khmer, kana and Han.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, share: float = ERROR_SHARE) -> int:
    """Edits allowed against the whole of an item."""
    return int(len(item) * share)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces with their places, as even as can be."""
    n = len(item)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def in_word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LMN" and not any(a <= ord(c) <= b for a, b in UNSPACED)


def on_bounds(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] cuts no word at either end."""
    return not any(0 < p < len(text) and in_word(text[p - 1]) and in_word(text[p]) for p in (a, b))


class Pattern:
    """Myers' bit vectors of one item; Python's integers are as wide as it is long."""

    def __init__(self, item: str):
        self.m = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def nearest(self, text: str) -> tuple[int, int]:
        """(least distance to any substring, end of the first such substring)."""
        m, full, top = self.m, (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score = full, 0, m
        best, at = m, 0
        get = self.masks.get
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & full  # a match may start anywhere: no 1 is shifted in
            pv = (mh << 1 & full) | (full & ~(xv | ph))
            mv = ph & xv
            if score < best:
                best, at = score, j + 1
        return best, at


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], share: float, min_chars: int):
        self.min_chars = min_chars
        self.items = [(i, t, budget(t, share) if len(t) >= min_chars else 0) for i, t in items if t]
        self.patterns: dict[int, Pattern] = {}
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for at, piece in pieces(t, k):
                places.setdefault(piece, []).append((n, at))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item id, distance, end in the normalised text) of each item found within its budget; the nearest occurrence of each."""
        t = normalised(text)
        if not self.items or not t:
            return []
        spots: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(t):
            for n, at in where:
                spots.setdefault(n, set()).add(end + 1 - length - at)
        found = []
        for n, starts in sorted(spots.items()):
            item_id, item, k = self.items[n]
            if len(item) < self.min_chars:
                if whole := [s + len(item) for s in starts if on_bounds(t, s, s + len(item))]:
                    found.append((item_id, 0, min(whole)))
                continue
            pattern = self.patterns.get(n) or self.patterns.setdefault(n, Pattern(item))
            best, stretches = None, []
            for s in sorted(starts):  # an item that lies within k edits starts within k of where its piece puts it
                a, b = max(0, s - k), min(len(t), s + len(item) + k)
                if stretches and a <= stretches[-1][1]:  # no part of the text is verified twice, however common a piece is
                    stretches[-1][1] = max(b, stretches[-1][1])
                else:
                    stretches.append([a, b])
            for a, b in stretches:
                d, e = pattern.nearest(t[a:b])
                if d <= k and (best is None or d < best[0]):
                    best = (d, a + e)
                if best is not None and best[0] == 0:
                    break
            if best:
                found.append((item_id, *best))
        return found


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """The query set in blocks. It is a stated set of queries; no block is larger than the bound, but for a single item that is."""
    sizes = items.select(F.xxhash64(id_col, text_col).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("size"))
    total, largest, count = sizes.agg(F.sum("size"), F.max("size"), F.count(F.lit(1))).first()
    n, bound = 1, max(block_bytes, largest or 0)
    while (total or 0) > bound and n < count and sizes.groupBy(F.pmod("h", F.lit(n))).agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] > bound:
        n = max(2 * n, -(-total // bound))
    part = F.pmod(F.xxhash64(id_col, text_col), F.lit(n))
    for b in range(n):
        yield [(r[0], normalised(r[1])) for r in items.where(part == b).select(id_col, text_col).orderBy(id_col).toLocalIterator()]


def first_chars(error_share: float, min_chars: int) -> int:
    """So many characters any piece of an item that isn't short has at least."""
    return max(1, min(n // (int(n * error_share) + 1) for n in range(max(1, min_chars), max(1, min_chars) + int(4 / max(error_share, 1e-3)))))


def gram_hashes(text: str, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < q:
        return np.empty(0, np.int64)
    h = np.zeros(len(codes) - q + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(q):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(h)] + np.uint64(1)
        return mixed(h).view(np.int64)


def _near_by_hash(rows: DataFrame, items: DataFrame, error_share: float, min_chars: int) -> DataFrame:
    """row, item_id, distance, end_pos: items that aren't short, found by a join of hashes. ``rows``: row, text."""
    q = first_chars(error_share, min_chars)

    def cut(columns):
        out = []
        for i, text in zip(*columns, strict=True):
            t = normalised(text)
            if len(t) >= min_chars:
                out.extend((int(gram_hashes(piece[:q], q)[0]), i, t, at) for at, piece in pieces(t, budget(t, error_share)))
        return [list(c) for c in zip(*out, strict=True)]

    parts = stored(map_rows(items.select("item_id", "text"), cut, "h long, item_id long, item string, at int"))
    known = parts.select("h").distinct()
    count, longest = known.count(), parts.agg(F.max(F.char_length("item"))).first()[0] or 0
    filtered = bloom_of(known, count) if count <= FILTER_KEYS else None
    width = longest + budget("x" * longest, error_share)

    def find(columns):
        out = []
        for row, text in zip(*columns, strict=True):
            t = normalised(text)
            h = gram_hashes(t, q)
            hit = np.flatnonzero(filtered.value.has(h)) if filtered else np.arange(len(h))
            for p in hit.tolist():
                a = max(0, p - width)
                out.append((int(h[p]), row, p, a, t[a : p + width]))
        return [list(c) for c in zip(*out, strict=True)]

    places = map_rows(rows.select("row", "text"), find, "h long, row long, p int, a int, around string", rows=64)

    def verify(columns):
        out, patterns = [], {}
        for row, p, a, around, i, item, at in zip(*columns, strict=True):
            k, start = budget(item, error_share), p - at
            lo, hi = max(0, start - k), start + len(item) + k
            if len(patterns) > 1000:
                patterns.clear()
            pattern = patterns.get(item) or patterns.setdefault(item, Pattern(item))
            d, e = pattern.nearest(around[max(0, lo - a) : hi - a])
            if d <= k:
                out.append((row, i, item, d, max(lo, a) + e))
        return [list(c) for c in zip(*out, strict=True)]

    met = places.join(parts, "h").select("row", "p", "a", "around", "item_id", "item", "at")
    found = map_rows(met, verify, "row long, item_id long, item string, distance int, end_pos int")
    return found.groupBy("row", "item_id", "item").agg(F.min(F.struct("distance", "end_pos")).alias("best")).select("row", "item_id", "best.*")


def contaminated(docs: DataFrame, items: DataFrame, error_share: float = ERROR_SHARE, min_chars: int = MIN_CHARS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: id, item_id, distance, end_pos. One pass over the texts, without shuffle where the items are few."""
    kind = docs.schema[id_col].dataType.simpleString()
    if not small(items, "text", block_bytes):
        rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))
        near = _near_by_hash(rows, items, error_share, min_chars).join(rows.select("row", "id"), "row").select(F.col("id").alias(id_col), "item_id", "distance", F.col("end_pos").cast("long").alias("end_pos"))
        few = stored(map_rows(items.select("item_id", "text"), lambda c: _short(c, min_chars), "item_id long, text string"))
        return near.unionByName(_in_blocks(rows, few, error_share, min_chars, block_bytes, "id", "text", kind).withColumnRenamed("id", id_col))
    return _in_blocks(docs, items, error_share, min_chars, block_bytes, id_col, text_col, kind)


def _short(columns: list[list], min_chars: int) -> list[list]:
    found = [(i, t) for i, t in zip(columns[0], map(normalised, columns[1]), strict=True) if 0 < len(t) < min_chars]
    return [list(c) for c in zip(*found, strict=True)]


def small(items: DataFrame, text_col: str, block_bytes: int) -> bool:
    return (items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) <= block_bytes


def _in_blocks(docs, items, error_share, min_chars, block_bytes, id_col, text_col, kind) -> DataFrame:
    """A pass over the texts for each block."""
    out = None
    for block in blocks(items, "item_id", "text", block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def each(matcher, columns):
            rows = [(i, *m) for i, t in zip(*columns, strict=True) for m in matcher.matches(t)]
            return [list(c) for c in zip(*rows, strict=True)]

        made = map_rows(docs.select(id_col, text_col), each, f"`{id_col}` {kind}, item_id long, distance int, end_pos long", lambda shared=shared: Matcher(shared.value, error_share, min_chars))
        out = made if out is None else out.unionByName(made)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, error_share: float = ERROR_SHARE, min_chars: int = MIN_CHARS, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """The documents without any match, all columns kept: decided in the same pass that reads the text, so nothing is joined.

    Where the items are many, texts with a match are told by 128 bits of their hash.
    """
    if not small(items, "text", block_bytes):
        text = F.coalesce(F.col(text_col), F.lit(""))
        hashes = F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
        found = contaminated(docs.select(hashes.alias("_hash"), F.col(text_col).alias("_text")), items, error_share, min_chars, block_bytes, "_hash", "_text")
        gone = stored(found.select(F.col("_hash.h1").alias("h1"), F.col("_hash.h2").alias("h2")).distinct())
        whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), hashes.alias("_hash"))
        kept = whole.join(gone, (F.col("_hash.h1") == F.col("h1")) & (F.col("_hash.h2") == F.col("h2")), "left_anti")
        return kept.select(*(F.col("_doc")[c].alias(c) for c in docs.columns))
    for block in blocks(items, "item_id", "text", block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = keep_rows(docs, text_col, lambda matcher, texts: [not matcher.matches(t) for t in texts], lambda shared=shared: Matcher(shared.value, error_share, min_chars))
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
