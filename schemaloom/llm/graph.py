"""Connected components of an undirected edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned


def _state(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rows_per_task: int = 250_000) -> DataFrame:
    """(node, component): component is the least node reachable; nodes without edges don't appear.

    ``edges`` has two long columns a and b. The minimum of a node's neighbours is aggregated map-side, so a hub
    costs no task more than its share; each round is cut with checkpoints and only its digest reaches the driver.
    Rounds run in as many tasks as the edges left need, so that a small table doesn't leave a file per shuffle
    partition and task.
    """
    e = pinned(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while (now := _state(e)) != before:
        before = now
        tasks = max(1, -(-now[0] // rows_per_task))
        few = e.coalesce(tasks)
        both = few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        large = pinned(large.distinct().coalesce(tasks))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a")
        star = star.select("a", F.col("m").alias("b")).unionByName(star.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = pinned(star.distinct().coalesce(tasks))
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
