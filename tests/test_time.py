"""Joins in time against slow ones; sessions over a stream that is stopped and started again."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from schemaloom.catalogue import extensions
from schemaloom.operators.intervals import asof_join, binned, range_join
from schemaloom.streaming import validation as S


@pytest.mark.parametrize("equal", [True, False])
def test_asof_join(spark, equal):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    left = [(i, key(), rng.choice([None] + [rng.randint(0, 60) for _ in range(9)])) for i in range(400)]
    right = [(key(), rng.choice([None] + [rng.randint(0, 60) for _ in range(9)]), i, "x") for i in range(200)]
    ldf, rdf = spark.createDataFrame(left, "id int, k string, t long"), spark.createDataFrame(right, "k string, t long, v int, id string")
    got = {r["id"]: (r["t_right"], r["v"], r["id_right"]) for r in asof_join(ldf, rdf, ["k"], "t", "t", allow_equal=equal, bins=8).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        fits = [(rt, v) for rk, rt, v, _ in right if rk == k is not None and None not in (rt, t) and (rt <= t if equal else rt < t)]
        assert got[i] == ((*max(fits), "x") if fits else (None, None, None)), (i, k, t)
    assert asof_join(ldf, rdf.limit(0), ["k"], "t", "t").count() == len(left) and asof_join(ldf.limit(0), rdf, ["k"], "t", "t").count() == 0


@pytest.mark.parametrize("equal", [True, False])
def test_asof_join_of_crowded_keys(spark, equal):
    """Keys on both sides of the bound; matches reach over bins without a right row, and ties go by the order asked for."""
    rng = random.Random(7)
    key = lambda: rng.choice(["hot"] * 8 + ["warm"] * 4 + ["a", None])
    left = [(i, key(), rng.choice([None] + [rng.randint(0, 400) for _ in range(9)])) for i in range(600)]
    right = [(key(), rng.choice([None, rng.choice([5, 6, 7, 300, 301]), rng.randint(0, 400)]), i % 7, i) for i in range(60)]
    ldf, rdf = spark.createDataFrame(left, "id int, k string, t long"), spark.createDataFrame(right, "k string, t long, v int, n int")
    got = asof_join(ldf, rdf, ["k"], "t", "t", allow_equal=equal, order=["v", "n"], bins=16, crowd=100).collect()
    assert len(got) == len(left)
    for r in got:
        fits = [(t, v, n) for k, t, v, n in right if k == r["k"] is not None and None not in (t, r["t"]) and (t <= r["t"] if equal else t < r["t"])]
        assert (r["t_right"], r["v"], r["n"]) == (max(fits) if fits else (None, None, None)), r


def test_asof_join_moves_rows_once(spark):
    """Without crowded keys there is one shuffle of the rows, and none to find them again."""
    rows = spark.range(100).selectExpr("id % 9 AS k", "id AS t", "id AS v")
    plan = asof_join(rows, rows, ["k"], "t", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("closed", [True, False])
def test_range_join(spark, closed):
    rng = random.Random(5)
    points = [(i, rng.choice("ab"), rng.choice([None, 7.0, rng.random() * 100])) for i in range(300)]
    spans = [(i, rng.choice("ab"), rng.choice([None, x := rng.random() * 90, 7.0]), rng.choice([None, x + rng.random() * 40, 7.0, 99.0])) for i in range(60)]
    p, s = spark.createDataFrame(points, "p int, k string, x double"), spark.createDataFrame(spans, "s int, k string, lo double, hi double")
    want = {(a, b) for a, k, x in points for b, j, lo, hi in spans if k == j and None not in (x, lo, hi) and (lo <= x <= hi if closed else lo <= x < hi)}
    for salts in (1, 3):
        got = [(r["p"], r["s"]) for r in range_join(p, s, "x", "lo", "hi", ["k"], closed, bins=8, salts=salts).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 500
    assert range_join(p, s.limit(0), "x", "lo", "hi", ["k"]).count() == 0


def test_sessions_of_a_stream_that_is_started_again(spark, tmp_path):
    base = datetime(2024, 1, 1)
    batches = [
        [(1, 0, "a"), (2, 5, "a"), (3, 30, "a"), (1, 0, "a"), (9, 2, "b")],
        [(4, 34, "a"), (2, 5, "a"), (5, 200, "a")],
        [(6, 1, "a"), (7, 201, "a"), (8, 500, "b")],  # the first is later than the watermark
    ]
    schema = "id int, ts timestamp, k string"
    source, out = tmp_path / "in", tmp_path / "out"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(a, base + timedelta(minutes=m), k) for a, m, k in rows], schema)
        df.coalesce(1).write.mode("append").parquet(str(source))
        stream = S.once(S.read_stream(spark, str(source), schema), "ts", ["id"], "20 minutes")
        S.to_files(S.bursts(stream, "ts", ["k"], "10 minutes"), str(out), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(out)).select("k", (F.unix_timestamp("began") - F.lit(int(base.timestamp()))).alias("s"), "n").collect()
    assert sorted((r["k"], (r["s"] % 86400) // 60, r["n"]) for r in got) == [("a", 0, 2), ("a", 30, 2), ("a", 200, 2), ("b", 2, 1)]


def test_range_join_of_a_larger_table_with_itself(spark):
    """Spans of sf0.1 are joined without a broadcast, with the table that they are made of."""
    sf, db = "/root/testdata/sf0.1", duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    want = db.sql(f"SELECT count(*), sum(n), sum(error * n) FROM ({extensions.SQL['x_range']})").fetchall()[0]
    assert tuple(extensions.x_range(spark, sf).agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("error") * F.col("n"))).first()) == want


def test_bins(spark):
    grid = [float(x) for x in range(0, 100, 3)]
    for n in (0, 1, 2, 7, 34):
        df = spark.createDataFrame([(x,) for x in (-5, 0, 1, 3, 50, 98, 99, 1000, None)], "t long")
        got = {r["t"]: r["_bin"] for r in binned(df, "t", grid[:n]).collect()}
        assert got == {t: 0 if t is None else sum(g <= t for g in grid[:n]) for t in got}
