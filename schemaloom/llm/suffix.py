"""Repeated substrings by enhanced suffix arrays and their common-prefix interval trees.

Every window of ``length`` bytes chooses an anchor, the least of its ``GRAMS[0]``-byte hashes; equal windows choose
equal anchors, so repeats can only lie among windows of equal anchors. Windows in a row with one anchor form a
context, a string of at most ``2 * length - GRAMS[0]`` bytes. Equal texts and equal contexts are one string with
several places, of which the first counts. The different contexts of an anchor are brought together; a suffix array
with longest common prefixes is built over them, its interval tree is found by a stack scan, and the intervals whose
left extensions differ are the maximal repeat groups, with all their occurrences. In each group the earliest occurrence
stays; the others are covered, and so is every context but the first of its kind.

An anchor with more than ``group_limit`` different contexts isn't brought together: its contexts are split by anchors
of the next length in ``GRAMS``, which are shared by fewer strings, and so on. The last length is that of the windows,
where the strings of an anchor are all equal, so that each group ends up small enough.

Which anchors repeat, and which contexts are the first of several, is told to the passes over the texts by Bloom
filters that are sized from their counts; what slips through costs a row, never a wrong result. More than
``filter_keys`` keys would make a filter too large to broadcast: shuffle joins then do the same.

Order: id (of its own type, null first), then text hash, then place. Defined results: a null text is empty; texts
shorter than ``length`` bytes have no repeats; matches never cross texts; rows of equal id and text are one document;
very long texts are hashed in stretches and repeat within themselves too; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, pinned, read, stored
from .neardup import mixed

LENGTH = 100
#: Lengths of the anchors, level by level; the windows' own length comes last.
GRAMS = (40, 70, 90)
GROUP_LIMIT = 1500
#: A Bloom filter has 16 bits a key, so one of so many keys has 128 MB, the most that is broadcast.
FILTER_KEYS = 64 << 20
#: As many anchors above the group limit are broadcast at most; more are joined with a shuffle.
BROADCAST_ANCHORS = 500_000
#: Texts are hashed in stretches of this many bytes.
STRETCH = 1 << 18
#: Suffix arrays are built over about this many bytes at once.
BLOCK = 200_000
_B = 0x9E3779B97F4A7C15 | 1


def contexts(texts: list[bytes], length: int = LENGTH, gram: int = GRAMS[0]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, start, number of windows, anchor hash) of all contexts, in arrays."""
    batch: list[tuple[int, int, bytes]] = []
    size = 0
    for n, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), STRETCH):
            part = t[at : at + STRETCH + length - 1]
            if len(part) < length:
                continue
            if size and size + len(part) > STRETCH:
                yield _contexts(batch, length, gram)
                batch, size = [], 0
            batch.append((n, at, part))
            size += len(part)
    if batch:
        yield _contexts(batch, length, gram)


def _contexts(batch, length, gram):
    joined = np.frombuffer(b"".join(p for _, _, p in batch), np.uint8)
    sizes = np.array([len(p) for _, _, p in batch])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    with np.errstate(over="ignore"):
        h, span, grams = joined.astype(np.uint64) + np.uint64(1), 1, {}
        while True:
            grams[span] = h
            if span * 2 > gram:
                break
            h = h[:-span] * np.uint64(pow(_B, span, 1 << 64)) + h[span:]
            span *= 2
        h, have = grams[span], span
        for s in sorted(grams, reverse=True):
            while have + s <= gram:
                h = h[: len(joined) - have - s + 1] * np.uint64(pow(_B, s, 1 << 64)) + grams[s][have : len(joined) - s + 1]
                have += s
        h = mixed(h)
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    w, span = length - gram + 1, 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if w > span:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    inside = np.ones(len(least), bool)
    for b, n in zip(begin[1:], sizes[:-1]):  # windows that start in the last length - 1 bytes of a text run into the next
        inside[b - length + 1 : b] = False
    at = np.flatnonzero(inside)
    place = (least[at] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    part = np.searchsorted(begin, start, "right") - 1
    number = np.array([n for n, _, _ in batch])[part]
    offset = np.array([o for _, o, _ in batch])[part]
    return number, start - begin[part] + offset, count, h[place[first]].view(np.int64)


def suffix_array(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string number, offset, left byte or -1, common prefix with the entry before) of the suffixes of ``length`` bytes or more, in order.

    The strings are contexts, so the suffixes are short and sorted as rows of bytes. The end of a string is like zero
    bytes; of rows that are equal so, shorter suffixes come first.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    width = int(sizes.max()) if len(sizes) else 0
    if width < length:
        return (np.empty(0, np.int64),) * 4
    text = np.frombuffer(b"".join(strings) + bytes(width), np.uint8)
    number = np.repeat(np.arange(len(strings)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    left = begin[number] + sizes[number] - np.arange(len(number))  # bytes from here to the string's end
    at = np.flatnonzero(left >= length)
    at = at[np.argsort(left[at], kind="stable")]
    rows = np.lib.stride_tricks.sliding_window_view(text, width)[at]
    rows[np.arange(width) >= left[at, None]] = 0
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    at, rows = at[order], rows[order]
    differ = np.pad(rows[1:] != rows[:-1], ((0, 0), (0, 1)), constant_values=True)
    common = np.minimum(differ.argmax(1), np.minimum(left[at[1:]], left[at[:-1]]))
    before = np.where(at > begin[number[at]], text[np.maximum(at - 1, 0)].astype(np.int64), -1)
    return number[at], at - begin[number[at]], before, np.concatenate([[0], common])


def intervals(common: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, end) of the interval tree's nodes of depth ``length`` or more, children before parents."""
    deep = common >= length
    edges = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):  # entries a - 1 .. b - 1 share a root of the scan
        stack: list[tuple[int, int]] = []
        for k, depth in enumerate(common[a:b].tolist(), a):
            first = k - 1
            while stack and stack[-1][0] > depth:
                d, first = stack.pop()
                yield d, first, k
            if not stack or stack[-1][0] < depth:
                stack.append((depth, first))
        while stack:
            d, first = stack.pop()
            yield d, first, b


def repeat_groups_of(strings: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, string numbers, offsets) of each maximal repeat of ``length`` bytes or more, with all its occurrences.

    An interval of the tree can't be extended to the right; it is maximal if its occurrences also differ in the byte
    before them. A start of a string extends to no byte, so it differs from any.
    """
    number, offset, before, common = suffix_array(strings, length)
    if not len(number):
        return
    changes = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))])
    for depth, a, b in intervals(common, length):
        if changes[b - 1] > changes[a]:
            yield depth, number[a:b], offset[a:b]


def covered(strings: list[bytes], order: list[tuple], length: int) -> list[list[tuple[int, int]]]:
    """For each string, the merged stretches in repeats that occur earlier; ``order`` gives (document key..., place) of each string's start."""
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    documents: dict[tuple, int] = {}
    key = np.empty(len(order), np.int64)
    for s in sorted(range(len(order)), key=order.__getitem__):
        key[s] = documents.setdefault(order[s][:-1], len(documents))
    place = np.array([o[-1] for o in order], np.int64)
    for depth, number, offset in repeat_groups_of(strings, length):
        document, at = key[number], place[number] + offset
        first = document.min()
        later = (document > first) | (at > at[document == first].min())
        for s, o in zip(number[later].tolist(), offset[later].tolist()):
            out[s].append((o, o + depth))
    return [merged(x) for x in out]


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted stretches that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Bloom(NamedTuple):
    """Three bits a key in a table of a power of two of bits."""

    words: np.ndarray

    @staticmethod
    def bits(keys: np.ndarray, size: int) -> list[np.ndarray]:
        h = mixed(keys.view(np.uint64))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [(h + np.uint64(i) * step) & np.uint64(size - 1) for i in range(3)]

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        with np.errstate(over="ignore"):
            for bit in self.bits(keys, 64 * len(self.words)):
                out &= (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def place_keys(th: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One key for a text's hash and a place in it."""
    with np.errstate(over="ignore"):
        return th.astype(np.int64).view(np.uint64) * np.uint64(_B) + start.astype(np.int64).view(np.uint64)


def bloom_of(keys: DataFrame, count: int) -> Broadcast:
    """A broadcast filter of the rows' keys, one long column or (th, start); ``count`` of them give its size."""
    size = 1 << max(16, (16 * count - 1).bit_length())

    def words(columns):
        a = [np.asarray(c, np.int64) for c in columns]
        with np.errstate(over="ignore"):
            bit = np.concatenate(Bloom.bits(place_keys(*a) if len(a) > 1 else a[0], size))
        word, of = np.unique(bit >> np.uint64(6), return_inverse=True)
        bits = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(bits, of, np.uint64(1) << (bit & np.uint64(63)))
        return [word.astype(np.int32), bits.view(np.int64)]

    got = map_rows(keys, words, "word int, bits long", rows=1 << 16).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[np.asarray(got["word"])] = np.asarray(got["bits"])
    return keys.sparkSession.sparkContext.broadcast(Bloom(table.view(np.uint64)))


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, th (64 bits of the text's hash), text as bytes."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def copies(texts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(doc, th) of the first document of each text, and of those whose text is a copy of an earlier one.

    Texts are told by 128 bits and their size; shorter ones than ``length`` are left out.
    """
    own = texts.select("doc", "th", F.xxhash64(F.lit(1), "text").alias("th2"), F.octet_length("text").alias("n")).where(F.col("n") >= length)
    own = pinned(own)
    first = own.groupBy("th", "th2", "n").agg(F.min(F.struct("doc")).alias("first"))
    first = pinned(first.select("th", "th2", "n", F.col("first.doc").alias("first")))
    later = own.join(first, ["th", "th2", "n"]).where(~F.col("doc").eqNullSafe(F.col("first"))).select("doc", "th").distinct()
    return first.select(F.col("first").alias("doc"), "th"), later


def chosen(known: Broadcast | None, columns: list[list]) -> list[list]:
    """The rows whose key, the last column, is in a filter, without it; decided within the map that needs them, so that there is one Python worker for a task."""
    *columns, keys = columns
    if known is None:
        return columns
    hit = np.flatnonzero(known.value.has(np.asarray(keys, np.int64))).tolist()
    return [[c[i] for i in hit] for c in columns]


def anchor_counts(texts: DataFrame, known: Broadcast | None, length: int) -> DataFrame:
    """a, n: how often each anchor occurs."""

    def count(columns):
        found = [h for *_, h in contexts(chosen(known, columns)[0], length)]
        a, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
        return [a, n.astype(np.int32)]

    return map_rows(texts.select("text", "key"), count, "a long, n int").groupBy("a").agg(F.sum("n").alias("n"))


def occurrences(texts: DataFrame, known: Broadcast | None, length: int, body: bool = False, anchors: Broadcast | None = None, places: Broadcast | None = None) -> DataFrame:
    """a, doc, th, start, and uh (the context's hash) and size or the context itself, of the contexts whose anchor or place is in a filter, or of all."""
    kind = texts.schema["doc"].dataType.simpleString()

    def emit(columns):
        docs, ths, raw = chosen(known, columns)
        th = np.asarray(ths, np.int64)
        rows = []
        for number, start, count, a in contexts(raw, length):
            if anchors:
                hit = np.flatnonzero(anchors.value.has(a))
            elif places:
                hit = np.flatnonzero(places.value.has(place_keys(th[number], start)))
            else:
                hit = np.arange(len(a))
            for n, s, c, h in zip(number[hit].tolist(), start[hit].tolist(), count[hit].tolist(), a[hit].tolist(), strict=True):
                b = raw[n][s : s + c + length - 1]
                rows.append((h, docs[n], ths[n], s, b) if body else (h, docs[n], ths[n], s, xxhash.xxh3_64_intdigest(b) - (1 << 63), len(b)))
        return [list(c) for c in zip(*rows, strict=True)]

    return map_rows(texts.select("doc", "th", "text", "key"), emit, f"a long, doc {kind}, th long, start long, {'body binary' if body else 'uh long, size int'}")


def place():
    return F.struct("doc", "th", "start")


def first_filter(first: DataFrame, filter_keys: int) -> Broadcast | None:
    """A filter of the documents that are no copies of earlier ones. Some copies may slip through, and all do where it would be too large; they cost rows only."""
    count = first.count()
    return bloom_of(first.select("key"), count) if count <= filter_keys else None


def scanned(strings: DataFrame, length: int) -> DataFrame:
    """doc, th, start, end of the stretches that occur earlier among the strings of an anchor; groups are small by construction."""
    grouped = strings.groupBy("a").agg(F.collect_list(F.struct("doc", "th", "start", "body")).alias("members")).where(F.size("members") > 1)
    kind = strings.schema["doc"].dataType.simpleString()

    def scan(columns):
        rows, members, size = [], [], 0

        def flush():
            order = [(m["doc"] is not None, m["doc"], m["th"], m["start"]) for m in members]
            for m, stretches in zip(members, covered([m["body"] for m in members], order, length), strict=True):
                rows.extend((m["doc"], m["th"], m["start"] + a, m["start"] + b) for a, b in stretches)
            members.clear()

        for group in columns[0]:
            members += group
            size += sum(len(m["body"]) for m in group)
            if size > BLOCK:
                flush()
                size = 0
        if members:
            flush()
        return [list(c) for c in zip(*rows, strict=True)]

    return map_rows(grouped.select("members"), scan, f"doc {kind}, th long, start long, end long")


def several(distinct: DataFrame, group_limit: int) -> tuple[DataFrame, DataFrame, int]:
    """Anchors of several contexts with their number m, those above the limit (hinted to be broadcast where they are few), and how many those are."""
    sizes = pinned(distinct.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    hot = sizes.where(F.col("m") > group_limit).select("a")
    count = hot.count()
    return sizes, F.broadcast(hot) if count <= BROADCAST_ANCHORS else hot, count


def refined(strings: DataFrame, length: int, group_limit: int, level: int) -> DataFrame:
    """doc, th, start, end of the stretches that occur earlier among contexts of anchors above the limit, split by longer anchors."""
    gram = (*GRAMS, length)[level]
    kind = strings.schema["doc"].dataType.simpleString()

    def split(columns):
        docs, ths, starts, bodies = columns
        rows = []
        for number, start, count, a in contexts(bodies, length, gram):
            for n, s, c, h in zip(number.tolist(), start.tolist(), count.tolist(), a.tolist(), strict=True):
                b = bodies[n][s : s + c + length - 1]
                rows.append((h, xxhash.xxh3_64_intdigest(b) - (1 << 63), docs[n], ths[n], starts[n] + s, b))
        return [list(c) for c in zip(*rows, strict=True)]

    parts = stored(map_rows(strings.select("doc", "th", "start", "body"), split, f"a long, uh long, doc {kind}, th long, start long, body binary"))
    distinct = stored(parts.groupBy("a", "uh").agg(F.min(place()).alias("first"), F.first("body").alias("body"), F.count(F.lit(1)).alias("n")))
    out = later_ones(parts.withColumn("size", F.octet_length("body")), distinct)
    sizes, hot, n_hot = several(distinct, group_limit)
    found = distinct.select("a", "first.*", "body").join(sizes.select("a"), "a", "left_semi")
    if n_hot:
        out = out.unionByName(refined(found.join(hot, "a", "left_semi"), length, group_limit, level + 1))
        found = found.join(hot, "a", "left_anti")
    return out.unionByName(scanned(found, length))


def later_ones(every: DataFrame, distinct: DataFrame) -> DataFrame:
    """doc, th, start, end of all contexts but the first of each kind; a kind with very many is split by Spark as a skewed key of a join."""
    known = distinct.where("n > 1").select("a", "uh", "first")
    return every.join(known, ["a", "uh"]).where(~place().eqNullSafe(F.col("first"))).select("doc", "th", "start", (F.col("start") + F.col("size")).cast("long").alias("end"))


class Found(NamedTuple):
    """What is known of repeats.

    ``rows``: doc, th, start, end. A row with an end is a stretch that occurs earlier; one with neither is a copy of an
    earlier text; one without an end is the start of a first context. Contexts of anchors in ``anchors`` (if that is
    used) that aren't first ones occur earlier as a whole.
    """

    rows: DataFrame
    anchors: Broadcast | None


def repeats(docs: DataFrame, length: int = LENGTH, group_limit: int = GROUP_LIMIT, filter_keys: int = FILTER_KEYS, id_col: str = "doc_id", text_col: str = "text") -> Found:
    """Passes over the texts, each of which moves little: anchors are counted; contexts of repeated anchors are moved
    as hashes and places; only the first of each kind are moved as strings, where their anchor has several."""
    key = F.xxhash64("doc", "th").alias("key")
    texts = text_rows(docs, id_col, text_col).select("*", key)
    first, whole = copies(texts, length)
    known = first_filter(first.select(key), filter_keys)
    repeated = pinned(anchor_counts(texts, known, length).where("n > 1").select("a"))
    n_repeated = repeated.count()
    anchors = bloom_of(repeated, n_repeated) if n_repeated <= filter_keys else None
    every = occurrences(texts, known, length, anchors=anchors)
    if anchors is None:
        every = stored(every.join(repeated, "a", "left_semi"))
    distinct = stored(every.groupBy("a", "uh").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("n")))

    sizes, hot, n_hot = several(distinct, group_limit)
    wanted = pinned(distinct.join(sizes.select("a"), "a", "left_semi").select("first.*"))
    n_wanted = wanted.count()
    if n_wanted <= filter_keys:
        strings = occurrences(texts, known, length, body=True, places=bloom_of(wanted.select("th", "start"), n_wanted))
    else:
        strings = wanted_strings(texts, wanted, length)
    gone = [F.lit(None).cast("long").alias(c) for c in ("start", "end")]
    rows = whole.select("doc", "th", *gone)
    if n_hot:
        strings = stored(strings)
        rows = rows.unionByName(refined(strings.join(hot, "a", "left_semi"), length, group_limit, 1))
        strings = strings.join(hot, "a", "left_anti")
    rows = rows.unionByName(scanned(strings, length))
    rows = rows.unionByName(later_ones(every, distinct) if anchors is None else distinct.select("first.*", gone[1]))
    return Found(rows, anchors)


def wanted_strings(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """a, doc, th, start, body of the contexts at certain places, where these are too many to be told by a filter: a text moves to its places."""
    kind = texts.schema["doc"].dataType.simpleString()
    starts = wanted.groupBy(F.col("doc").alias("d"), F.col("th").alias("t")).agg(F.collect_set("start").alias("starts"))
    both = texts.join(starts, F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("doc", "th", "text", "starts")

    def emit(columns):
        docs, ths, raw, starts = columns
        rows = []
        for number, start, count, a in contexts(raw, length):
            for n, s, c, h in zip(number.tolist(), start.tolist(), count.tolist(), a.tolist(), strict=True):
                if s in starts[n]:
                    rows.append((h, docs[n], ths[n], s, raw[n][s : s + c + length - 1]))
        return [list(c) for c in zip(*rows, strict=True)]

    return map_rows(both, emit, f"a long, doc {kind}, th long, start long, body binary")


def repeat_groups(docs: DataFrame, length: int = LENGTH, group_limit: int = GROUP_LIMIT, filter_keys: int = FILTER_KEYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """group_id, length, id, start: the maximal repeat groups of the interval trees, with all their occurrences.

    Repeats are found within contexts, so a longer one is a chain of groups. A context that occurs several times as a whole
    is a group, too. Groups are told by the hash of their bytes.
    """
    texts = text_rows(docs, id_col, text_col).select("*", F.xxhash64("doc", "th").alias("key"))
    repeated = pinned(anchor_counts(texts, None, length).where("n > 1").select("a"))
    n_repeated = repeated.count()
    anchors = bloom_of(repeated, n_repeated) if n_repeated <= filter_keys else None
    every = occurrences(texts, None, length, anchors=anchors)
    every = stored(every if anchors else every.join(repeated, "a", "left_semi"))
    distinct = stored(every.groupBy("a", "uh").agg(F.min(place()).alias("first"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n")))
    wanted = pinned(distinct.select("first.*"))
    n_wanted = wanted.count()
    found = occurrences(texts, None, length, body=True, places=bloom_of(wanted.select("th", "start"), n_wanted)) if n_wanted <= filter_keys else wanted_strings(texts, wanted, length)
    strings = found.join(distinct.select("a", "first.*"), ["a", "th", "start"], "left_semi").dropDuplicates(["a", "body"])
    whole = distinct.where("n > 1").select("a", "uh", F.lit(0).cast("long").alias("off"), F.col("size").cast("long").alias("length"), F.col("uh").alias("group_id"))
    groups = whole.unionByName(_groups(strings.select("a", F.lit(None).cast("long").alias("oa"), F.lit(None).cast("long").alias("uh"), F.lit(0).cast("long").alias("off"), "body"), length, group_limit, 0)).distinct()
    joined = every.join(groups, ["a", "uh"])
    return joined.select("group_id", "length", F.col("doc").alias(id_col), (F.col("start") + F.col("off")).alias("start")).distinct()


def _groups(strings: DataFrame, length: int, group_limit: int, level: int) -> DataFrame:
    """a, uh (of the context), off, length, group_id of each occurrence of a group in the strings of an anchor; strings that were cut from a context name it in oa and uh."""
    told = "a long, uh long, off long, length long, group_id long"
    digest = lambda b: xxhash.xxh3_64_intdigest(b) - (1 << 63)

    def own(columns):
        anchor, oa, uh, off, bodies = columns
        return [[a if o is None else o for a, o in zip(anchor, oa, strict=True)], [digest(b) if u is None else u for b, u in zip(bodies, uh, strict=True)], off, bodies, anchor]

    strings = stored(map_rows(strings.select("a", "oa", "uh", "off", "body"), own, "oa long, uh long, off long, body binary, a long"))
    sizes = strings.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    if level == len(GRAMS):  # the strings of an anchor are one window
        both = strings.join(sizes, "a")
        return both.select(F.col("oa").alias("a"), "uh", "off", F.octet_length("body").cast("long").alias("length"), F.xxhash64("body").alias("group_id"))
    hot = pinned(sizes.where(F.col("m") > group_limit).select("a"))
    usual = strings.join(sizes.where(F.col("m") <= group_limit).select("a"), "a", "left_semi")
    grouped = usual.groupBy("a").agg(F.collect_list(F.struct("oa", "uh", "off", "body")).alias("members"))

    def scan(columns):
        rows = []
        for members in columns[0]:
            bodies = [m["body"] for m in members]
            for depth, number, offset in repeat_groups_of(bodies, length):
                group = digest(bodies[number[0]][offset[0] : offset[0] + depth])
                rows.extend((members[n]["oa"], members[n]["uh"], members[n]["off"] + o, depth, group) for n, o in zip(number.tolist(), offset.tolist(), strict=True))
        return [list(c) for c in zip(*rows, strict=True)]

    out = map_rows(grouped.select("members"), scan, told)
    if hot.isEmpty():
        return out

    def split(columns):
        oa, uh, off, bodies = columns
        rows = []
        for number, start, count, a in contexts(bodies, length, (*GRAMS, length)[level + 1]):
            rows.extend((h, oa[n], uh[n], off[n] + s, bodies[n][s : s + c + length - 1]) for n, s, c, h in zip(number.tolist(), start.tolist(), count.tolist(), a.tolist(), strict=True))
        return [list(c) for c in zip(*rows, strict=True)]

    parts = map_rows(strings.join(hot, "a", "left_semi").select("oa", "uh", "off", "body"), split, "a long, oa long, uh long, off long, body binary")
    return out.unionByName(_groups(parts, length, group_limit, level + 1))


def drop_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """id, n_bytes, removed (merged stretches as array<struct<start, end>>), kept (the remaining bytes)."""
    rows, anchors = repeats(docs, length, id_col=id_col, text_col=text_col, **options)
    found = rows.select(F.col("doc").alias("d"), F.col("th").alias("t"), "start", "end")
    found = found.groupBy("d", "t").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    texts = text_rows(docs, id_col, text_col)
    joined = texts.join(found, F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select("doc", "text", "found")

    def cut(columns):
        ids, raw, known = columns
        gone = [[(x["start"], x["end"]) for x in f or () if x["end"] is not None] for f in known]
        first = [{x["start"] for x in f or () if x["end"] is None} for f in known]
        for n, f in enumerate(first):
            if None in f:
                gone[n] = [(0, len(raw[n]))]
        if anchors:
            rest = [t if None not in f else b"" for t, f in zip(raw, first, strict=True)]
            for number, start, count, a in contexts(rest, length):
                hit = np.flatnonzero(anchors.value.has(a))
                for n, s, c in zip(number[hit].tolist(), start[hit].tolist(), count[hit].tolist(), strict=True):
                    if s not in first[n]:
                        gone[n].append((s, s + c + length - 1))
        removed, kept = [], []
        for t, s in zip(raw, map(merged, gone), strict=True):
            at, parts = 0, []
            for a, b in s:
                parts.append(t[at:a])
                at = b
            parts.append(t[at:])
            removed.append([{"start": a, "end": b} for a, b in s])
            kept.append(b"".join(parts))
        return [ids, [len(t) for t in raw], removed, kept]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(joined, cut, f"`{id_col}` {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
