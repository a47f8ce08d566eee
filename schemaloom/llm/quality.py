"""Host-level quality rules.

Each document is judged by rules; failures are summed by host, each host's failure rate is shrunk towards
the corpus by an empirical beta prior (moments of a beta-binomial over hosts), and the host verdicts are joined back.
A verdict is a tail of the host's posterior: a host is condemned if its odds of failing the base rules surely are above
``factor`` times those of the corpus; a soft rule counts against a document where its host surely fails that rule more
often than the corpus does.

Defined results: a null or empty text has no words and fails the base rule; very long texts are measured whole; a null
host is a host of its own that is never condemned; repeated rows count as often as they come; a tail equal to the
confidence asked for is sure; other columns are ignored; an empty table gives no rows (the prior is then flat).
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, pinned, read

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")

#: Soft rules, which reject a document only on a host that fails them too often.
SOFT = ("symbols", "dup_lines", "repeats")


#: As many hosts are broadcast at most; each of more is spread over so many salts.
BROADCAST_HOSTS = 200_000
SALTS = 32
#: Bounds of a prior's strength in documents; hosts that spread no more than chance has it get the greatest.
MIN_STRENGTH, MAX_STRENGTH = 0.1, 1e6


class Stats(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def repeat_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    pair = code[:-2] * v + code[1:-1]
    if v < 2_000_000:
        window = pair * v + code[2:]
    else:  # three codes don't fit in 63 bits
        window = np.unique(pair, return_inverse=True)[1].astype(np.int64) * v + code[2:]
    order = np.argsort(window, kind="stable")
    s = window[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def measure(text: str | None) -> Stats:
    text = text or ""
    words = WORDS.findall(text)
    dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        dup = len(lines) - len(set(lines))
    return Stats(len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), dup, repeat_words(words))


def document_rules(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics of each document and the rules that it fails."""
    kind = docs.schema[id_col].dataType.simpleString()
    host = docs.schema[host_col].dataType.simpleString()
    out = map_rows(
        docs.select(id_col, host_col, text_col),
        lambda c: [c[0], c[1], *map(list, zip(*map(measure, c[2]), strict=True))],
        f"`{id_col}` {kind}, host {host}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long",
    )
    words, dup = F.col("n_words"), F.col("n_dup_lines")
    return out.withColumns(
        {
            "base_failed": (words < 50) | (100 * F.col("n_repeat_words") > 50 * words),
            "fail_symbols": 10 * F.col("n_symbols") > words,
            "fail_dup_lines": (dup >= 5) & (20 * dup > words),
            "fail_repeats": 100 * F.col("n_repeat_words") > 20 * words,
        }
    )


def beta_tail(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(X > x) of Beta(a, b): the regularized incomplete beta function by its continued fraction (modified Lentz)."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    p, q, z = b, a, np.full(a.shape, 1.0 - x)
    swap = z > (p + 1) / (p + q + 2)  # the fraction converges fast on one side of the mean
    p, q, z = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - z, z)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(p), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
    out, m, moved = d.copy(), 0, np.inf
    while len(p) and moved > 1e-13:
        m += 1
        for k in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * d * c
        moved = np.abs(d * c - 1).max()
    value = np.clip(front * out, 0, 1)
    return np.where(swap, 1 - value, value)


class Prior(NamedTuple):
    """Beta prior of a rule's failure rate over hosts, and the rate above which a host stands out."""

    alpha: float
    beta: float
    limit: float


def fitted_prior(failed: int, n: int, hosts: int, sizes: int, shares: int, factor: float) -> Prior:
    """By the moments of a beta-binomial: the corpus rate is the mean; the hosts' spread beyond what drawing their documents
    makes by itself gives the strength. Hosts weigh by their documents, so many small ones don't pass for a wide spread.

    ``sizes`` is the sum of squares of the hosts' numbers of documents, ``shares`` that of failures squared by documents, in millionths.
    """
    mean = min(max(failed / n if n else 0.5, 1e-4), 1 - 1e-4)
    odds = factor * mean / (1 - mean)
    strength = MAX_STRENGTH
    if hosts > 1 and n > hosts:
        shared = int(shares) / 1e6
        between = (shared - failed * failed / n) / (hosts - 1)
        within = (failed - shared) / (n - hosts)
        size = (n - int(sizes) / n) / (hosts - 1)  # of a host, about
        alike = (between - within) / max(between + (size - 1) * within, 1e-12)  # correlation of two documents of a host
        strength = min(max((1 - alike) / alike, MIN_STRENGTH), MAX_STRENGTH) if alike > 0 else MAX_STRENGTH
    return Prior(mean * strength, (1 - mean) * strength, odds / (1 + odds))


def host_verdicts(judged: DataFrame, factor: float = 4.0, confidence: float = 0.95, soft_confidence: float = 0.9) -> DataFrame:
    """One row per host: shrunk failure rates and whether the host is condemned, as a whole or under a soft rule.

    The prior of each rule comes from one row of moments (whole numbers, so the order of summing doesn't matter).
    """
    rules = ("base_failed", *(f"fail_{r}" for r in SOFT))
    hosts = pinned(judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(F.col(r).cast("long")).alias(f"n_{r}") for r in rules)))
    moments = []
    for r in rules:
        k = F.col(f"n_{r}").cast("decimal(15,0)")
        moments += [F.sum(f"n_{r}"), F.sum(F.floor(k * k * 1_000_000 / F.col("n_docs")).cast("decimal(38,0)"))]
    docs = F.col("n_docs").cast("decimal(15,0)")
    n, count, sizes, *sums = hosts.agg(F.sum("n_docs"), F.count(F.lit(1)), F.sum(docs * docs), *moments).first()
    priors = [fitted_prior(sums[2 * i] or 0, n or 0, count, sizes or 0, sums[2 * i + 1] or 0, 1.0 if i else factor) for i in range(len(rules))]
    sure = [soft_confidence if i else confidence for i in range(len(rules))]

    def judge(columns):
        docs = np.array(columns[1], float)
        rates, bad = [], []
        for failed, prior, least in zip(columns[2:], priors, sure, strict=True):
            a, b = prior.alpha + np.array(failed, float), prior.beta + docs - np.array(failed, float)
            rates.append(a / (a + b))
            bad.append([h is not None and bool(t >= least) for h, t in zip(columns[0], beta_tail(prior.limit, a, b), strict=True)])
        return [columns[0], columns[1], *rates, *bad]

    kind = judged.schema["host"].dataType.simpleString()
    verdicts = ("host_condemned", *(f"host_bad_{r}" for r in SOFT))
    return map_rows(hosts, judge, f"host {kind}, n_docs long, " + ", ".join([f"rate_{r} double" for r in rules] + [f"{v} boolean" for v in verdicts]))


def with_hosts(judged: DataFrame, hosts: DataFrame) -> DataFrame:
    """The documents with their host's verdict. Few hosts are broadcast; of more, each is spread over salts with its documents, so that a hot host isn't one task."""
    hosts = pinned(hosts.withColumnsRenamed({"host": "host_key", "n_docs": "host_docs"}))
    same = F.col("host").eqNullSafe(F.col("host_key"))
    if hosts.count() <= BROADCAST_HOSTS:
        return judged.join(F.broadcast(hosts), same, "left").drop("host_key")
    spread = hosts.withColumn("salt_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = judged.withColumn("salt", F.pmod(F.xxhash64(judged.columns[0]), F.lit(SALTS)).cast("int"))
    return salted.join(spread, same & (F.col("salt") == F.col("salt_key")), "left").drop("host_key", "salt", "salt_key")


def quality_rules(docs: DataFrame, host_col: str = "source", **thresholds: float) -> DataFrame:
    """Statistics, rules and the verdict of each document. Only the few numbers of each document are pinned and joined, never its text."""
    judged = pinned(document_rules(docs, host_col))
    joined = with_hosts(judged, host_verdicts(judged, **thresholds))
    soft = F.lit(False)
    for r in SOFT:
        soft = soft | (F.col(f"fail_{r}") & F.col(f"host_bad_{r}"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_condemned") & ~soft)


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rate_base_failed")
