"""Bags, order and terminals of selections; projection of documents into typed instances."""

import pytest
from pyspark.sql import functions as F

from schemaloom.operators import validation as V
from schemaloom.operators.quads import Emitter, deskolemized, lift
from schemaloom.operators.selection import CardinalityError, Graph
from schemaloom.plans.compiler import Compiler
from schemaloom.plans.project import Projector
from schemaloom.plans.registry import Registry
from schemaloom.plans.values import Variant

T = {"$id": "urn:t", "type": "object", "properties": {"n": {"type": "integer"}, "next": {"type": "string", "x-own-iriRef": True}}}


@pytest.fixture(scope="module")
def graph(spark):
    df = spark.createDataFrame([(2, "urn:c", 5, "urn:a"), (0, "urn:a", 7, "urn:b"), (1, "urn:b", 7, "urn:c")], "place int, s string, n int, next string")
    q = Emitter(Registry([T])).quads(df, "urn:t", F.col("s"), V.row_value(df), F.col("place"))
    return Graph(q, resolver=lambda n: f"urn:t#{n}")


def iris(s):
    return [r["iri"] for r in s.rows.orderBy("ord", "iri").collect()]


def test_order_and_terminals(graph):
    every = graph.instances("urn:t")
    assert iris(every) == ["urn:a", "urn:b", "urn:c"]
    assert every.first() == "urn:a"
    assert iris(every.limit(2)) == ["urn:a", "urn:b"]
    assert iris(every.limit(-2)) == ["urn:a"]
    assert (every.count(), every.some(), every.none()) == (3, True, False)
    with pytest.raises(CardinalityError):
        every.one()
    assert graph.instances("urn:t").having("n", 5).one() == "urn:c"


def test_bags_and_hops(graph):
    every = graph.instances("urn:t")
    two = every.union(every)
    assert two.count() == 6
    assert iris(two.distinct()) == ["urn:a", "urn:b", "urn:c"]
    assert two.intersect(graph.resource("urn:b")).count() == 2
    assert iris(graph.resource("urn:a").objects("next")) == ["urn:b"]
    assert iris(graph.resource("urn:a").subjects("next")) == ["urn:c"]
    assert sorted(iris(graph.resource("urn:a").closure("next"))) == ["urn:a", "urn:b", "urn:c"]
    assert sorted(iris(graph.resource("urn:a").subgraph(1))) == ["urn:a", "urn:b"]


def test_order_by_is_stable(graph, spark):
    x = lift(graph.quads, Registry([T]), "urn:t")
    assert iris(graph.instances("urn:t").order_by(x, F.col("instance.n"))) == ["urn:c", "urn:a", "urn:b"]
    assert iris(graph.instances("urn:t").top(x, 1, F.col("instance.n").desc())) == ["urn:a"]


def test_genids_become_blank_nodes(spark):
    df = spark.createDataFrame([("http://e/.well-known/genid/x1", 3)], "s string, n int")
    q = Emitter(Registry([T])).quads(df, "urn:t", F.col("s"), V.row_value(df))
    assert {(r["s"], r["s_kind"]) for r in deskolemized(q).collect()} == {("_:x1", "bnode")}


COERCED = [("5", 5), ("", 0), ("0x10", 16), (" 7 ", 7), (True, 1), (2.9, 2), (-2.9, -2), ("x", None), (None, None)]


@pytest.mark.parametrize(("given", "want"), COERCED)
def test_integers_are_coerced(spark, given, want):
    import json

    r = Registry([{"$id": "urn:i", "type": "object", "properties": {"n": {"type": "integer"}}}])
    df = spark.createDataFrame([(json.dumps({"n": given}),)], "j string").select(F.parse_json("j").alias("d"))
    assert df.select(Projector(r).project("urn:i", Variant(F.col("d")))["n"]).first()[0] == want


def test_instances_fill_defaults_and_refuse_computed_input(spark):
    r = Registry([{"$id": "urn:i", "type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer"}, "b": {"type": "string", "default": "x"}}}])
    r.add_computed("urn:i", "twice", lambda v: v.get("a").number() * 2)
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "twice": 5}',), ('{"a": "no"}',)], "j string").select(F.parse_json("j").alias("d"))
    rows = V.instantiate(df, Compiler(r), "urn:i", "d").collect()
    assert rows[0]["instance"].asDict() == {"a": 1, "b": "x", "twice": 2.0}
    assert [e["keyword"] for e in rows[1]["errors"]] == ["computed"]
    assert [e["keyword"] for e in rows[2]["errors"]] == ["type"]
    assert rows[1]["instance"] is None


def nested(levels):
    s = {"type": "object", "properties": {"n": {"type": "integer"}}}
    for _ in range(levels):
        s = {"type": "object", "properties": {"n": {"type": "integer"}, "in": s}}
    return Registry([s | {"$id": "urn:deep"}])


def deep(levels, name="in"):
    d = {"n": levels}
    for i in reversed(range(levels)):
        d = {"n": i, name: d}
    return d


def documents(spark, registry, schema_id, document):
    import json

    df = spark.createDataFrame([("urn:x", json.dumps(document))], "s string, j string").select("s", F.parse_json("j").alias("d"))
    return Emitter(registry).quads(df, schema_id, F.col("s"), Variant(F.col("d"))), df


def test_nesting_is_followed_as_deep_as_the_schema_goes(spark):
    q, df = documents(spark, nested(12), "urn:deep", deep(12))
    assert q.where(F.col("p") == "urn:deep#n").count() == 13
    only = Emitter(nested(12), only={"urn:deep#n"}).quads(df, "urn:deep", F.col("s"), Variant(F.col("d")))
    assert only.count() == 13
    q, _ = documents(spark, nested(5), "urn:deep", deep(5))
    found = [r for r in lift(q.cache(), nested(5), "urn:deep").collect() if r["s"] == "urn:x"]
    assert found[0]["instance"].asDict(True) == deep(5)


def test_recursion_below_the_bound_is_an_error(spark):
    r = Registry([{"$id": "urn:r", "type": "object", "properties": {"n": {"type": "integer"}, "in": {"$ref": "urn:r"}}}])
    assert documents(spark, r, "urn:r", deep(9))[0].where(F.col("p") == "urn:r#n").count() == 10
    with pytest.raises(Exception, match="nested deeper than 9 times"):
        documents(spark, r, "urn:r", deep(10))[0].collect()
    three = documents(spark, r, "urn:r", deep(1))[0].cache()
    assert {x["s"]: x["instance"]["n"] for x in lift(three, r, "urn:r", depth=1).collect()} == {"urn:x": 0, "urn:x/in": 1}
    four = documents(spark, r, "urn:r", deep(2))[0].cache()
    with pytest.raises(Exception, match="nested deeper than lift"):
        lift(four, r, "urn:r", depth=1).collect()
