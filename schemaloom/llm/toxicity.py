"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over the hashed terms that a text holds: its words and,
for inflected forms, their beginnings. The pairwise part learns that two terms together mean more than their
weights add up to.

The model is fitted on a bounded sample of labelled rows (``max_rows`` per class, those with the smallest hash of
their id), never on the held-out fold. Each class weighs as all its labelled ids do, so that a score of 0.5 means the
same whatever share of a class is in the sample. Label, language, source and id are no features.

Defined results: a null or empty text gets the score of no terms; a very long text is read whole; of rows of equal
hash the lesser id is sampled first; a score of exactly 0.5 counts as toxic; contradicting labels of one id count as toxic;
without labels of both classes every score is the base rate (0 without labels); repeated rows give repeated
results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, keep_rows, map_rows, pinned, read

WORD = re.compile(r"[^\W\d_]+")
BITS = 18
PREFIXES = (4, 5, 6)
FOLDS, FOLD = 5, 0


def buckets(word: str) -> tuple[int, ...]:
    """A word's hashed terms: itself, and its beginnings where it is longer."""
    terms = [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]
    return tuple(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for t in terms)


class Terms(dict):
    """word -> the buckets that ``active`` lets through; emptied when full."""

    def __init__(self, active: np.ndarray | None):
        super().__init__()
        self.active = None if active is None else {int(b): i for i, b in enumerate(active)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = buckets(word)
        out = found if self.active is None else tuple(self.active[b] for b in found if b in self.active)
        if len(self) > 400_000:
            self.clear()
        if len(word) <= 40:
            self[word] = out
        return out

    def of(self, text: str | None) -> list[int]:
        out: set[int] = set()
        for word in set(WORD.findall((text or "").lower())):
            if got := self[word]:
                out.update(got)
        return sorted(out)


@dataclass
class FactorizationMachine:
    """Weights of the active buckets only: w0, w (n), v (n x k); the sample's size bounds theirs."""

    active: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logit(self, rows: list[list[int]]) -> np.ndarray:
        out = np.full(len(rows), self.w0)
        for r, idx in enumerate(rows):
            if idx:
                v = self.v[idx]
                out[r] += self.w[idx].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return out

    def score(self, rows: list[list[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(rows), -60, 60)))


def deviates(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """By how many standard errors shares a / n1 and b / n0 differ."""
    p = (a + b + 1.0) / (n1 + n0 + 2.0)
    return (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))


def choose_terms(rows: list[np.ndarray], y: np.ndarray, z: float, pair_z: float, pair_terms: int) -> np.ndarray:
    """The buckets that say something alone or in pairs; there is no cap on their number.

    Alone: their shares among toxic and other rows differ by more than ``z`` standard errors. In pairs: the shares of
    rows that hold both differ by more than ``pair_z``, and more than either's own; so terms that only mean something
    together are found, too. Pairs are tried among the ``pair_terms`` buckets that split the sample most evenly.
    """
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    count = lambda want: np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == want] or [np.empty(0, np.int64)]), minlength=1 << BITS)
    a, b = count(1), count(0)
    alone = np.abs(deviates(a, b, n1, n0))
    share = (a + b) / (n1 + n0)
    tried = np.sort(np.argsort(-share * (1 - share), kind="stable")[:pair_terms])
    tried = tried[a[tried] + b[tried] > 0]
    both = {1.0: np.zeros((len(tried),) * 2, np.float32), 0.0: np.zeros((len(tried),) * 2, np.float32)}
    for want, sums in both.items():
        mine = [r for r, t in zip(rows, y, strict=True) if t == want]
        for at in range(0, len(mine), 512):
            x = indicators(mine[at : at + 512], tried).astype(np.float32)
            sums += x.T @ x
    strong = np.zeros(len(tried), bool)
    for i, (p, q) in enumerate(zip(both[1.0], both[0.0], strict=True)):
        together = np.abs(deviates(p, q, n1, n0))
        together[i] = 0
        strong[i] = (together > np.maximum(pair_z, 1.2 * np.maximum(alone[tried[i]], alone[tried]))).any()
    return np.union1d(np.flatnonzero(alone > z), tried[strong])


def indicators(rows: list[np.ndarray], active: np.ndarray) -> np.ndarray:
    """1 where a row holds an active bucket."""
    x = np.zeros((len(rows), len(active)), np.uint8)
    place = np.full(1 << BITS, -1, np.int64)
    place[active] = np.arange(len(active))
    for i, r in enumerate(rows):
        at = place[r]
        x[i, at[at >= 0]] = 1
    return x


def fit(rows: list[np.ndarray], y: np.ndarray, weights: np.ndarray | None = None, factors: int = 8, z: float = 5.0, pair_z: float = 6.5, pair_terms: int = 2048, epochs: int = 40, seed: int = 7) -> FactorizationMachine:
    """Logistic loss by AdaGrad over mini-batches, each row by its weight; w and v shrink a little."""
    none = np.empty(0, np.int64)
    if len(y) == 0 or y.min() == y.max():
        rate = 0.0 if len(y) == 0 else float(y[0])
        return FactorizationMachine(none, -60.0 if rate == 0 else 60.0, np.empty(0), np.empty((0, factors)))
    weights = np.ones(len(y)) if weights is None else weights / weights.mean()
    rate = np.average(y, weights=weights)
    active = choose_terms(rows, y, z, pair_z, pair_terms)
    x = indicators(rows, active)
    rng = np.random.default_rng(seed)
    w0, w, v = np.log(rate / (1 - rate)), np.zeros(len(active)), rng.normal(0, 0.02, (len(active), factors))
    g0, gw, gv = 1e-6, np.full(w.shape, 1e-6), np.full(v.shape, 1e-6)
    lam = 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 256):
            i = order[at : at + 256]
            xb = x[i].astype(np.float32)  # the features are 0 or 1, so their squares are the same
            s = xb @ v
            logit = w0 + xb @ w + 0.5 * ((s**2).sum(1) - (xb @ v**2).sum(1))
            e = weights[i] * (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y[i]) / len(i)
            d0, dw = e.sum(), xb.T @ e + lam * w
            dv = xb.T @ (e[:, None] * s) - v * (xb.T @ e)[:, None] + lam * v
            g0, gw, gv = g0 + d0**2, gw + dw**2, gv + dv**2
            w0, w, v = w0 - 0.1 * d0 / np.sqrt(g0), w - 0.1 * dw / np.sqrt(gw), v - 0.05 * dv / np.sqrt(gv)
    return FactorizationMachine(active, float(w0), w, v)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed terms, labels and weights (labelled ids of the class for each one sampled) of the sample; at most ``2 * max_rows`` rows, so both the broadcast ids and what the driver gets are bounded."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", FOLDS, FOLD))
    usable = pinned(usable.groupBy("doc_id").agg(F.max((F.col("toxic").cast("int") == 1).cast("int")).alias("toxic")))
    label: dict[int, int] = {}
    weight = {}
    for y, n in usable.groupBy("toxic").count().collect():
        sample = usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()
        label |= {r["doc_id"]: y for r in sample}
        weight[y] = n / len(sample)
    if not label:
        return [], np.empty(0), np.empty(0)
    ids = docs.sparkSession.createDataFrame(sorted(label), "long").toDF("_labelled")
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), F.col("_id") == F.col("_labelled"), "left_semi")
    found = map_rows(chosen, lambda terms, c: [c[0], [terms.of(t) for t in c[1]]], "id long, terms array<int>", lambda: Terms(None)).toArrow()
    order = sorted(zip(found["id"].to_pylist(), (np.asarray(x.values, np.int64) for x in found["terms"].combine_chunks()), strict=True), key=lambda x: (x[0], len(x[1])))
    return [r for _, r in order], np.array([label[i] for i, _ in order], float), np.array([weight[label[i]] for i, _ in order])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, **options) -> FactorizationMachine:
    return fit(*labelled_sample(docs, labels, max_rows), **options)


def score_toxicity(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted (1 from 0.5 on): one map over the texts; the model's size is fixed by its parameters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(state, columns):
        terms, fm = state
        s = fm.score([terms.of(t) for t in columns[1]])
        return [columns[0], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), each, f"`{id_col}` {kind}, score double, predicted int", lambda: (Terms(shared.value.active), shared.value))


def drop_toxic(docs: DataFrame, model: FactorizationMachine, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score under ``limit``, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = lambda state, texts: (state[1].score([state[0].of(t) for t in texts]) < limit).tolist()
    return keep_rows(docs, text_col, keep, lambda: (Terms(shared.value.active), shared.value))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", "predicted")
