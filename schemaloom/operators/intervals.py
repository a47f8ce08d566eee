"""Joins in time: as of a moment, and of points with intervals.

Both cut the time line into bins that hold about as many rows each (approximate quantiles, of a fixed number), so that no
task gets a whole key. An as-of join does so with crowded keys only; a match carries over from earlier bins by one row for each
of these keys and bin.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import pinned

BINS = 256
#: Rows of a key beyond which an as-of join spreads it over bins.
CROWD = 1 << 17


def quantile_grid(values: DataFrame, column: str, bins: int = BINS) -> list:
    """Ascending cut points between bins of about as many rows each; at most ``bins`` - 1."""
    kind = values.schema[column].dataType.simpleString()
    number = F.col(column).cast("double") if kind not in ("timestamp", "timestamp_ntz") else F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    row = values.select(number.alias("v")).where("v IS NOT NULL").agg(F.percentile_approx("v", [i / bins for i in range(1, bins)], 10_000)).first()
    return sorted(set(row[0] or []))


def binned(df: DataFrame, column: str, grid: list, name: str = "_bin") -> DataFrame:
    """With the number of cut points at or below a time, 0 for null. A binary search, each step a column of its own, so that it is
    compiled; a condition on all cut points within one expression is interpreted, and moved by the optimizer to where the time is missing."""
    kind = df.schema[column].dataType.simpleString()
    number = F.unix_micros(F.col(column).cast("timestamp")).cast("double") if kind in ("timestamp", "timestamp_ntz") else F.col(column).cast("double")
    out, points = df.withColumns({"_time": number, name: F.lit(0)}), F.array(*map(F.lit, grid))
    for step in (1 << i for i in reversed(range(len(grid).bit_length()))):
        out = out.withColumn(name, F.col(name) + F.when(F.get(points, F.col(name) + (step - 1)) <= F.col("_time"), step).otherwise(0))
    return out.drop("_time")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, suffix: str = "_right", allow_equal: bool = True, order: list[str] = (), bins: int = BINS, crowd: int = CROWD) -> DataFrame:
    """Each left row with the right row of its keys that is the latest at its time (or before it, without ``allow_equal``).

    Left rows without a match stay, with nulls. Of right rows of one key and time, the last by ``order`` (all columns where
    none is given) is taken, so results don't depend on how rows are dealt. A null key or time matches nothing. Columns of
    the right side besides the keys get ``suffix`` where the left side has the name.

    Both sides are moved once and read in order. A key of more than ``crowd`` rows is cut into bins; the last right row of a
    bin is copied to those after it, as far as the next that has one, so at most ``bins`` rows are added for each such key.
    """
    names = {c: c + suffix if c in left.columns else c for c in right.columns if c not in by}
    keys, (left_side, right_side) = [f"_by{i}" for i in range(len(by))], (1, 0) if allow_equal else (0, 1)
    last = F.struct(*(F.col(c).alias(f"_order{i}") for i, c in enumerate(order or [])), *(F.col(c) for c in right.columns if c not in by))

    def known(time: str) -> Column:
        return reduce(and_, (F.col(c).isNotNull() for c in (*by, time)))

    def placed(df: DataFrame, time: str, side: int, row: Column, name: str) -> DataFrame:
        return df.where(known(time)).select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(time).alias("_t"), F.lit(side).alias("_side"), row.alias(name))

    both = placed(left, left_time, left_side, F.struct(*left.columns), "_left").unionByName(placed(right, right_time, right_side, last, "_row"), allowMissingColumns=True)
    crowded = pinned(both.groupBy(*keys).count().where(F.col("count") > crowd).select(*keys, F.lit(True).alias("_crowded")))
    if crowded.isEmpty():
        both = both.withColumn("_bin", F.lit(0))
    else:
        both = both.join(F.broadcast(crowded), keys, "left")
        grid = quantile_grid(both.where("_crowded"), "_t", bins)
        both = binned(both, "_t", grid).withColumn("_bin", F.when(F.col("_crowded"), F.col("_bin")).otherwise(0))
        ends = both.where(F.col("_crowded") & (F.col("_side") == right_side)).groupBy(*keys, "_bin").agg(F.max(F.struct("_t", "_row")).alias("_end"))
        until = F.coalesce(F.lead("_bin").over(Window.partitionBy(*keys).orderBy("_bin")), F.lit(len(grid)))
        later = ends.withColumn("_until", until).where("_bin < _until").select(*keys, "_end._t", F.lit(right_side).alias("_side"), "_end._row", F.explode(F.sequence(F.col("_bin") + 1, "_until")).alias("_bin"))
        both = both.drop("_crowded").unionByName(later, allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_bin").orderBy("_t", "_side", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_row", F.last("_row", ignorenulls=True).over(within)).where(F.col("_side") == left_side)
    matched = found.select(*(F.col("_left")[c].alias(c) for c in left.columns), *(F.col("_row")[c].alias(n) for c, n in names.items()))
    nothing = (F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in names.items())
    return matched.unionByName(left.where(~known(left_time)).select(*left.columns, *nothing))


def range_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, by: list[str] = (), closed: bool = False, bins: int = BINS, salts: int = 1) -> DataFrame:
    """Pairs of a point and an interval that holds it: start <= point < end, or <= end where ``closed``.

    An interval is copied to the bins that it overlaps, ``bins`` times at most, and bins are cut where points are dense; with
    ``salts`` points of a bin are dealt over that many tasks, each with a copy of its intervals. Null points or bounds match nothing.
    """
    grid = quantile_grid(points.select(F.col(point).alias("v")), "v", bins)
    p = binned(points.where(F.col(point).isNotNull()), point, grid).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    keep = F.col(start) <= F.col(end) if closed else F.col(start) < F.col(end)
    i = binned(binned(intervals.where(keep), start, grid, "_lo"), end, grid, "_hi")
    i = i.withColumn("_bin", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    held = (F.col(start) <= F.col(point)) & (F.col(point) <= F.col(end) if closed else F.col(point) < F.col(end))
    return p.join(i, [*by, "_bin", "_salt"]).where(held).drop("_bin", "_salt")
