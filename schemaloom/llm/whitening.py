"""Whitening of embeddings: covariance in double-double, and its eigenvectors by tridiagonal divide and conquer.

The fit list is each distinct vector once, in whole numbers x = floor(64 c) + 1000000. Its size n and the sums S by
dimension are exact. Centred values x - S/n are double-doubles: the whole part and the fraction of the mean are taken off
separately. Each task splits them into slices of so few bits that the products of two slices, summed over a block of
rows, fit a double without rounding (an error-free transformation of the outer products, as matrix products), and adds
the products to its sums with two-sums, a high and a low part for each entry. Parts of all tasks merge row by row of the
matrix, in two steps, so that no group grows with the number of tasks alone. The matrix, of the square of the dimension,
goes to the driver; LAPACK's dsyevd (``numpy.linalg.eigh``) reduces it to a tridiagonal one and solves that by divide and
conquer; one Newton step in extended precision then refines vectors and values with the low parts.

Defined results: a vector that is null, empty, or holds null or non-finite entries is dropped, and so is one whose
length isn't the most frequent (of equally frequent ones the longest); vectors are told apart by x, so repeated rows
count once in the fit and each have rows of their own in the output; a null id stays; entries beyond 2**55 in absolute
value are taken as 2**55; directions in which the fit list doesn't vary (e at most 1e-13 of the largest) have no
components, so a single distinct vector has none, and an empty table gives no rows; deviation is null where it doesn't
fit 64 bits; other columns aren't carried on.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, discard, read, stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Bits of a slice and rows of a block: a product of two slices has 2 * 20 bits, and 2**12 of them sum exactly.
SLICE, BLOCK = 20, 4096
#: Merging of partial matrices goes by way of so many groups for each row of the matrix.
SPREAD = 32
MATRIX = "i int, hi array<double>, lo array<double>"
FLAT = 1e-13


def whole_numbers(df: DataFrame, vec_col: str, id_col: str) -> DataFrame:
    """id, x (array of whole numbers): the usable vectors."""
    v = F.col(f"`{vec_col}`")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    limit = float(1 << 55)
    x = F.transform(v, lambda c: (F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(limit)), F.lit(-limit))) + F.lit(SHIFT)).cast("long"))
    return df.where(fine).select(F.col(f"`{id_col}`").alias("id"), x.alias("x"))


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(hi: np.ndarray, lo: np.ndarray, more: np.ndarray, less: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) + (more, less), each a double-double."""
    s, e = two_sum(hi, more)
    t, f = two_sum(lo, less + np.zeros_like(lo))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


class Mean(NamedTuple):
    """S / n in three parts: a whole number, and the fraction's high and low part."""

    n: int
    sums: list[int]
    whole: np.ndarray
    hi: np.ndarray
    lo: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Mean:
        parts = [divmod(s, n) for s in sums]
        hi = [r / n for _, r in parts]
        lo = [float(Fraction(r, n) - Fraction(h)) for (_, r), h in zip(parts, hi, strict=True)]
        return cls(n, sums, np.array([q for q, _ in parts], np.int64), np.array(hi), np.array(lo))

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = x - self.whole
        top = d.astype(np.float64)
        hi, lo = two_sum(top, -self.hi)
        return two_sum(hi, lo + ((d - top.astype(np.int64)) - self.lo))


def outer_sums(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the rows' outer products as a double-double matrix; rows are double-doubles."""
    d = hi.shape[1]
    total, rest = np.zeros((d, d)), np.zeros((d, d))
    for at in range(0, len(hi), BLOCK):
        h, left = hi[at : at + BLOCK], lo[at : at + BLOCK]
        _, e = np.frexp(np.abs(h).max(initial=0.0))
        slices = []
        for k in range(1, 4):  # what is left after three slices is below the high part's last bit, and goes in as a fourth
            grid = 1.5 * 2.0 ** (int(e) + 53 - 1 - k * SLICE)
            part = (h + grid) - grid
            slices.append(part)
            h = h - part
        slices.append(h + left)
        products = [(a, b) for a in range(4) for b in range(a, 4) if a + b < 5]
        for a, b in sorted(products, key=sum):
            p = slices[a].T @ slices[b]
            total, rest = add(total, rest, p)
            if a != b:
                total, rest = add(total, rest, np.ascontiguousarray(p.T))
    return total, rest


def matrix_rows(table: pa.RecordBatch, name: str) -> np.ndarray:
    column = table.column(name)
    return np.asarray(column.flatten()).reshape(len(column), -1)


def covariance(fit: DataFrame, column: str, centred, divisor: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of outer products over ``divisor``, as a double-double matrix; ``centred`` gives the rows of an array of vectors as double-doubles."""
    schema = arrow_schema_of(MATRIX)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi = lo = None
        for batch in batches:
            if batch.num_rows:
                h, e = outer_sums(*centred(matrix_rows(batch, column)))
                hi, lo = (h, e) if hi is None else add(hi, lo, h, e)
        if hi is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(hi)), pa.int32()), pa.array(list(hi), schema.field(1).type), pa.array(list(lo), schema.field(2).type)], schema=schema)

    def merge(key, rows):
        hi = lo = None
        for batch in rows.to_batches():
            for h, e in zip(matrix_rows(batch, "hi"), matrix_rows(batch, "lo"), strict=True):
                hi, lo = (h, e) if hi is None else add(hi, lo, h, e)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([hi], schema.field(1).type), pa.array([lo], schema.field(2).type)], schema=schema)

    parts = fit.select(column).mapInArrow(sums, MATRIX)
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    once = salted.groupBy("i", "salt").applyInArrow(merge, MATRIX)
    rows = once.groupBy("i").applyInArrow(merge, MATRIX).orderBy("i").collect()
    hi, lo = np.array([r["hi"] for r in rows]), np.array([r["lo"] for r in rows])
    q = hi / divisor
    return q, np.array(((hi.astype(np.longdouble) - q.astype(np.longdouble) * divisor) + lo) / divisor, float)


def arrow_schema_of(ddl: str) -> pa.Schema:
    from pyspark.sql import types as T

    return arrow_schema(T.StructType.fromDDL(ddl))


def eigen(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest down and unit eigenvectors as columns."""
    symmetric = (hi + hi.T) / 2
    values, vectors = np.linalg.eigh(symmetric)
    a = hi.astype(np.longdouble) + lo.astype(np.longdouble)
    a, x = (a + a.T) / 2, vectors.astype(np.longdouble)
    # one step of Ogita and Aishima: vectors are set right to first order by what orthogonality and the residual say
    r = np.eye(len(x), dtype=np.longdouble) - x.T @ x
    s = x.T @ (a @ x)
    exact = np.diag(s) / (1 - np.diag(r))
    gap = exact[None, :] - exact[:, None]
    near = 2 * (np.linalg.norm(np.array(s - np.diag(exact), float)) + abs(float(exact[-1])) * np.linalg.norm(np.array(r, float)))
    far = np.abs(gap) > near
    e = np.where(far, (s + exact[None, :] * r) / np.where(far, gap, 1), r / 2)
    x = x + x @ e
    x = x / np.sqrt((x * x).sum(0))
    order = np.argsort(-exact, kind="stable")
    return np.array(exact[order], float), np.array(x[:, order], float)


class Whitening(NamedTuple):
    mean: Mean
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        hi, lo = self.mean.centred(x)
        return (hi @ self.vectors + lo @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, in whole numbers."""
        n, sums, base = self.mean.n, self.mean.sums, self.mean.whole
        d = x - base
        rest = np.array([s - n * int(b) for s, b in zip(sums, base, strict=True)], dtype=object)
        reach = (int(np.abs(d).max(initial=0)) + 1) * n
        if reach**2 * x.shape[1] < 2**62:
            return ((d * n - rest.astype(np.int64)) ** 2).sum(1).tolist()
        exact = ((d.astype(object) * n - rest) ** 2).sum(1)
        return [v if v < 2**63 else None for v in exact]


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of (id, x) vectors, and the stored list of distinct x that it was fitted on."""
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    fit = stored(vectors.where(F.size("x") == d).select("x").distinct())
    sums = [F.sum(F.get("x", i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)]
    n, *totals = fit.agg(F.count("x"), *sums).first()
    if not n:
        return None, fit
    mean = Mean.of(n, [int(t) for t in totals])
    hi, lo = covariance(fit, "x", mean.centred, n)
    values, directions = eigen(hi, lo)
    kept = min(components, int((values > FLAT * max(values[0], 0)).sum()) if values[0] > 0 else 0)
    return Whitening(mean, values[:kept], directions[:, :kept], float(np.trace(hi) + np.trace(lo))), fit


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    k = len(w.values)
    where = fit.sparkSession.sparkContext.broadcast(w)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = where.value.project(matrix_rows(batch, "x")).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(z)], names=["i", "z"])

    got = {r["i"]: r["z"] / w.mean.n for r in fit.select("x").mapInArrow(totals, "i int, z double").groupBy("i").agg(F.sum("z").alias("z")).collect()}
    middle = np.array([got[i] for i in range(k)])

    def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return two_sum(where.value.project(x), np.broadcast_to(-middle, (len(x), k)))

    hi, _ = covariance(fit, "x", centred, w.mean.n)
    return float(np.abs(hi - np.eye(k)).max())


def whitened(vectors: DataFrame, w: Whitening, error: float) -> DataFrame:
    """A row for each vector and component; a map over the vectors with a model of the square of the dimension."""
    shared = vectors.sparkSession.sparkContext.broadcast(w)
    d, kind = len(w.mean.sums), vectors.schema["id"].dataType.simpleString()
    ddl = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = arrow_schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        share = m.values / m.trace
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = matrix_rows(batch, "x")
                each = np.repeat(np.arange(len(x)), k)
                columns = [
                    batch.column(0).take(pa.array(each)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(each), m.mean.n),
                    pa.array(m.deviations(x), pa.int64()).take(pa.array(each)), m.project(x).ravel(), np.tile(share, len(x)), np.full(len(each), error),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return vectors.where(F.size("x") == d).select("id", "x").mapInArrow(run, ddl)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: fitted on all of the table's distinct vectors."""
    vectors = whole_numbers(df, vec_col, id_col)
    w, fit = fit_whitening(vectors, components)
    if w is None or not len(w.values):
        kind = vectors.schema["id"].dataType.simpleString()
        out = df.sparkSession.createDataFrame([], f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    else:
        out = whitened(vectors, w, identity_error(fit, w))
    discard(fit)
    return out.withColumnRenamed("id", id_col)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
