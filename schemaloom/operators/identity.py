"""Identity over pairs of nodes: connected components of sameAs, contradictions with differentFrom, and rule joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import pinned


def components(pairs: DataFrame) -> DataFrame:
    """node, component (least node reachable) of pairs (a, b): each round hooks every label to the least of its neighbours' and shortcuts it.

    Minima are aggregated map-side, so that a node of many pairs costs no task more than its share.
    """
    edges = pinned(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = pinned(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = edges.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = label.join(near, "node").select("node", "component", F.least("component", "near").alias("to"))
        far = label.select(F.col("node").alias("to"), F.col("component").alias("far"))
        new = pinned(hooked.join(far, "to").select("node", F.least("to", "far").alias("component"), (F.least("to", "far") != F.col("component")).alias("moved")))
        label = new.select("node", "component")
        if new.where("moved").isEmpty():
            return label


def contradictions(same: DataFrame, different: DataFrame) -> DataFrame:
    """The pairs (a, b) said to be different whose nodes are the same."""
    of = components(same)
    a = of.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = of.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return different.join(a, "a").join(b, "b").where(F.col("ca") == F.col("cb")).select("a", "b")


def structural_duplicates(nodes: DataFrame, top: DataFrame) -> DataFrame:
    """Sub-documents (owner, pointer, hash) equal to a top-level one (id, hash) of another owner; a hash that several top-level ones share matches none."""
    unique = top.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("match")).where("n = 1").select("hash", "match")
    return nodes.join(unique, "hash").where(F.col("owner") != F.col("match")).select("owner", "pointer", "match")


def sub_class_closure(edges: DataFrame) -> DataFrame:
    """(sub, super) pairs reachable over subclass edges (sub, super): the closure doubles its reach each round."""
    known = pinned(edges.select("sub", "super").distinct())
    while True:
        more = known.join(known.select(F.col("sub").alias("super"), F.col("super").alias("next")), "super").select("sub", F.col("next").alias("super"))
        new = pinned(more.distinct().join(known, ["sub", "super"], "left_anti"))
        if new.isEmpty():
            return known
        known = pinned(known.unionByName(new))
