"""What the reference has no operator for, on Spark's own: streams, windows, grouping sets, joins in time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import validation as V
from ..operators.intervals import asof_join, range_join
from ..streaming import validation as S
from .common import Catalogue, compiler, table

C = Catalogue()
EVENT = {"$id": "urn:example:event", "type": "object", "properties": {"value": {"type": "number", "maximum": 100}, "event_type": {"enum": ["click", "view", "purchase"]}}}


@C.query("SELECT event_type, count(*) AS n_rows, count(*) FILTER (value > 100 OR event_type NOT IN ('click', 'view', 'purchase')) AS n_invalid FROM events GROUP BY 1")
def x_stream_errors(spark, sf_dir):
    """The stream of events, validated and counted by type; the whole table is the stream."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = S.read_stream(spark, sf_dir, batch.schema, pathGlobFilter="events.parquet")
    checked = S.validated(stream, compiler(EVENT), EVENT["$id"])
    bad = (F.size("errors") > 0).cast("long")
    counted = checked.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(bad).alias("n_invalid"))
    return S.run_once(counted, "x_stream_errors", "complete")


@C.query("SELECT date_trunc('hour', ts) AS window_start, count(*) AS n_rows, count(*) FILTER (value > 100 OR event_type NOT IN ('click', 'view', 'purchase')) AS n_invalid FROM events GROUP BY 1")
def x_error_windows(spark, sf_dir):
    checked = V.with_errors(table(spark, sf_dir, "events"), compiler(EVENT), EVENT["$id"])
    return S.error_rates(checked, "ts", "1 hour", "10 minutes").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_rows", "n_invalid")


@C.query("SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)::INTEGER AS place FROM customer QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) <= 3")
def x_window_rank(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc())
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.rank().over(w).alias("place")).where("place <= 3")


@C.query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice > 250000) AS n_bad FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def x_cube_profile(spark, sf_dir):
    c = compiler({"$id": "urn:example:o", "properties": {"o_totalprice": {"maximum": 250000}}})
    df = V.with_errors(table(spark, sf_dir, "orders"), c, "urn:example:o")
    return df.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum((F.size("errors") > 0).cast("long")).alias("n_bad"))


@C.query("SELECT c_nationkey, min(c_acctbal) AS low, max(c_acctbal) AS high, count(DISTINCT c_mktsegment) AS n_segments FROM customer GROUP BY 1")
def x_profile(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.count_distinct("c_mktsegment").alias("n_segments"))


@C.query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS high FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def x_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("high"))


@C.query("SELECT user_id AS k FROM events EXCEPT ALL SELECT o_custkey FROM orders")
def x_except_all(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("k")).exceptAll(table(spark, sf_dir, "orders").select("o_custkey"))


@C.query("SELECT user_id AS k FROM events INTERSECT ALL SELECT o_custkey FROM orders")
def x_intersect_all(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("k")).intersectAll(table(spark, sf_dir, "orders").select("o_custkey"))


@C.query("SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS middle, quantile_disc(l_quantity, 0.9) AS high FROM lineitem GROUP BY 1")
def x_quantiles(spark, sf_dir):
    of = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY l_quantity)")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(of(0.5).alias("middle"), of(0.9).alias("high"))


@C.query("""SELECT l_orderkey, l_linenumber, l_partkey, o_orderkey AS last_order, o_orderdate AS last_date FROM (SELECT *, l_suppkey AS k FROM lineitem)
  ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) ON k = o_custkey AND l_shipdate >= o_orderdate""")
def x_asof(spark, sf_dir):
    """Each shipment with the latest order that the customer of its supplier's number had made by then."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("k"), "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey")
    out = asof_join(lines, orders, ["k"], "l_shipdate", "o_orderdate", order=["o_orderkey"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("o_orderkey").alias("last_order"), F.col("o_orderdate").alias("last_date"))


@C.query("""WITH r AS (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until, user_id FROM events WHERE event_type = 'error')
  SELECT r.event_id AS error, count(*) AS n, sum(e.value) AS total FROM r JOIN events e ON e.user_id = r.user_id AND r.ts <= e.ts AND e.ts < r.until GROUP BY 1""")
def x_range(spark, sf_dir):
    """Events of a user between one error and the next."""
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    spans = events.where("event_type = 'error'").select(F.col("event_id").alias("error"), "user_id", F.col("ts").alias("since"), F.lead("ts").over(w).alias("until"))
    pairs = range_join(events.select("user_id", "ts", "value"), spans, "ts", "since", "until", by=["user_id"], salts=2)
    return pairs.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@C.query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events WHERE event_type = 'error'),
  s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM e)
  SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, i""")
def x_error_bursts(spark, sf_dir):
    """The stream of errors in sessions by user, that end with six hours without one; events that come twice count once."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = S.read_stream(spark, sf_dir, batch.schema, pathGlobFilter="events.parquet")
    twice = stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    found = S.bursts(S.once(twice.where("event_type = 'error'"), "ts", ["event_id"], "40 days"), "ts", ["user_id"], "6 hours")
    out = S.run_once(found, "x_error_bursts", "complete")
    return out.select("user_id", F.col("began").cast(batch.schema["ts"].dataType).alias("began"), "n")


QUERIES, SQL = C.queries, C.sql
