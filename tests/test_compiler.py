"""Keyword scenarios, check against errors: a document is valid exactly if it has no errors."""

import json
import random

import pytest
from pyspark.sql import functions as F

from schemaloom.catalogue import validation
from schemaloom.operators.validation import is_valid, row_value
from schemaloom.plans.compiler import Compiler
from schemaloom.plans.registry import Registry, SchemaError
from schemaloom.plans.values import Variant

TREE = {"$id": "urn:t", "type": "object", "required": ["v"], "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "urn:t"}}}}
SCENARIOS = [
    ({"type": "integer"}, [1, 1.0, -3], [1.5, "1", None, True]),
    ({"type": ["string", "null"]}, ["", None], [0, {}]),
    ({"enum": [1, "a", None, {"x": [1]}]}, [1.0, "a", None, {"x": [1]}], [2, {"x": [2]}, True]),
    ({"const": {"a": 1, "b": 2}}, [{"b": 2, "a": 1}], [{"a": 1}, 1]),
    ({"minimum": 2, "exclusiveMaximum": 4}, [2, 3.9, "text"], [1, 4]),
    ({"multipleOf": 0.1}, [0.3, 1, 1.1], [0.35]),
    ({"minLength": 2, "maxLength": 3}, ["😀😀", "abc", 7], ["😀", "abcd"]),
    ({"pattern": "^a.c$"}, ["abc", 1], ["xabc", "abc\n"]),
    ({"required": ["a"]}, [{"a": None}, "text"], [{}, {"b": 1}]),
    ({"properties": {"a": {"type": "string"}}, "additionalProperties": False}, [{}, {"a": "x"}], [{"a": 1}, {"b": 1}]),
    ({"patternProperties": {"^n_": {"type": "number"}}, "additionalProperties": {"type": "string"}}, [{"n_a": 1, "b": "x"}], [{"n_a": "x"}, {"b": 1}]),
    ({"propertyNames": {"pattern": "^[a-z]+$"}}, [{"a": 1}], [{"A": 1}]),
    ({"minProperties": 1, "maxProperties": 2}, [{"a": 1}], [{}, {"a": 1, "b": 1, "c": 1}]),
    ({"dependentRequired": {"a": ["b"]}}, [{"b": 1}, {"a": 1, "b": 1}], [{"a": 1}]),
    ({"dependentSchemas": {"a": {"required": ["c"]}}}, [{}, {"a": 1, "c": 1}], [{"a": 1}]),
    ({"items": {"type": "integer"}, "minItems": 1, "maxItems": 2}, [[1], [1, 2], "x"], [[], [1, 2, 3], ["a"]]),
    ({"prefixItems": [{"type": "string"}, {"type": "integer"}], "items": False}, [[], ["a"], ["a", 1]], [[1], ["a", 1, 2]]),
    ({"uniqueItems": True}, [[1, 2], [[1], [2]]], [[1, 1.0], [{"a": 1, "b": 2}, {"b": 2, "a": 1}]]),
    ({"contains": {"type": "integer"}, "maxContains": 2}, [[1], [1, "a", 2]], [[], ["a"], [1, 2, 3]]),
    ({"contains": {"const": 5}, "minContains": 0}, [[], [5]], []),
    ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, [2], [0, 4]),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["a", 3], [2]),
    ({"oneOf": [{"minimum": 1}, {"maximum": 3}]}, [0, 4], [2]),
    ({"not": {"type": "string"}}, [1, None], ["a"]),
    ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"required": ["a"]}, "else": {"required": ["b"]}}, [{"k": 1, "a": 1}, {"b": 1}], [{"k": 1}, {"k": 2}]),
    ({"allOf": [{"properties": {"a": {}}}], "unevaluatedProperties": False}, [{"a": 1}], [{"b": 1}]),
    ({"anyOf": [{"properties": {"a": {"const": 1}}, "required": ["a"]}, {"properties": {"b": {}}, "required": ["b"]}], "unevaluatedProperties": False}, [{"a": 1}, {"a": 1, "b": 2}], [{"a": 2, "b": 1}, {"a": 1, "c": 1}]),
    ({"prefixItems": [True], "unevaluatedItems": {"type": "string"}}, [[1], [1, "a"]], [[1, 2]]),
    ({"format": "email"}, ["a@b.co", 5], ["a@b"]),
    ({"contentEncoding": "base64", "contentMediaType": "application/json"}, ["e30="], ["e30=x*", "YQ=="]),
    ({"$ref": "urn:t"}, [{"v": 1, "kids": [{"v": 2}]}], [{"v": 1, "kids": [{"v": "x"}]}, {"kids": []}]),
    ({"properties": {"x": {"$ref": "#/$defs/p"}}, "$defs": {"p": {"$anchor": "pos", "exclusiveMinimum": 0}}}, [{"x": 1}], [{"x": 0}]),
]


@pytest.mark.parametrize("place", range(len(SCENARIOS)))
def test_scenario(spark, place):
    schema, good, bad = SCENARIOS[place]
    c = Compiler(Registry([TREE, {"$id": "urn:s"} | schema]))
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate([*good, *bad])], "i int, j string").withColumn("d", F.parse_json("j"))
    v = Variant(F.col("d"))
    rows = df.select("i", "j", c.check("urn:s", v).alias("ok"), c.errors("urn:s", v).alias("e")).orderBy("i").collect()
    for r in rows:
        assert r["ok"] == (r["i"] < len(good)), r["j"]
        assert r["ok"] == (not r["e"]), r["j"]


def test_error_paths_and_order(spark):
    c = Compiler(Registry([TREE]))
    df = spark.createDataFrame([('{"kids": [{"v": "x"}, {}]}',)], "j string").select(F.parse_json("j").alias("d"))
    found = df.select(F.explode(c.errors("urn:t", Variant(F.col("d")))).alias("e")).select("e.*").collect()
    assert [(r["path"], r["keyword"]) for r in found] == [("", "required"), ("/kids/0/v", "type"), ("/kids/1", "required")]


def test_registry_refuses():
    with pytest.raises(SchemaError):
        Registry([{"type": "string"}])
    with pytest.raises(SchemaError):
        Registry([{"$id": "urn:x", "properties": {"p": {"symmetric": True, "asymmetric": True}}}])
    with pytest.raises(SchemaError):
        Registry([{"$id": "urn:x", "$schema": "http://json-schema.org/draft-07/schema#"}])
    r = Registry([{"$id": "urn:a", "type": "integer", "minimum": 3}, {"$id": "urn:b", "properties": {"p": {"type": "integer", "minimum": 3, "title": "t"}}}])
    assert r.find_duplicates() == [("urn:b", "/properties/p", "urn:a")]


SELF = {
    "$id": "urn:self", "type": "object", "required": ["n"],
    "properties": {"n": {"type": "integer", "minimum": 0}, "a": {"$ref": "#"}, "b": {"anyOf": [{"type": "null"}, {"$ref": "#"}]}, "c": {"not": {"$ref": "urn:self"}}, "kids": {"items": {"$ref": "#"}}},
    "patternProperties": {"^x": {"$ref": "#"}},
}


def slow_valid(d, depth=0):
    """SELF by recursion over the document; nodes 100 schemas deep are valid."""
    if depth >= 100:
        return True
    inner = lambda x, more: depth + more >= 100 or slow_valid(x, depth + more)
    if not isinstance(d, dict) or "n" not in d:
        return False
    n = d["n"]
    if depth + 1 < 100 and not (isinstance(n, (int, float)) and not isinstance(n, bool) and n == int(n) and n >= 0):
        return False
    ok = "a" not in d or inner(d["a"], 2)
    ok &= "b" not in d or d["b"] is None or inner(d["b"], 3)
    ok &= "c" not in d or depth + 1 >= 100 or not inner(d["c"], 3)
    ok &= "kids" not in d or not isinstance(d["kids"], list) or depth + 1 >= 100 or all(inner(x, 3) for x in d["kids"])
    return ok and all(inner(x, 2) for k, x in d.items() if k.startswith("x"))


def made_document(rng, depth):
    d = {"n": rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 7.0, -1] + ["z"] * (rng.random() < 0.1))} if rng.random() > 0.03 else {}
    for k in ("a", "b", "c", "x1", "x2"):
        if depth and rng.random() < 0.45:
            d[k] = made_document(rng, depth - 1) if rng.random() < 0.9 else rng.choice([None, 5, []])
    if depth and rng.random() < 0.5:
        d["kids"] = [made_document(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return d


def test_recursive_schemas_against_recursion_over_documents(spark):
    rng = random.Random(2)
    docs = [made_document(rng, 4) for _ in range(150)]
    for bad in (False, True):
        for k in (10, 48, 49, 50, 51, 100):
            d = {"n": -1 if bad else 1}
            for i in range(k):
                d = {"n": i, ("a", "x1")[i % 2]: d}
            docs.append(d)
    docs += [None, 5, {"kids": 5, "n": 1}]
    c = Compiler(Registry([SELF, {"$id": "urn:outer", "properties": {"t": {"$ref": "urn:self"}}, "additionalProperties": False}]))
    df = spark.createDataFrame([(i, json.dumps(d), json.dumps({"t": d})) for i, d in enumerate(docs)], "i int, j string, w string").select("i", F.parse_json("j").alias("d"), F.parse_json("w").alias("w"))
    v = Variant(F.col("d"))
    rows = df.select("i", c.check("urn:self", v).alias("ok"), c.errors("urn:self", v).alias("e"), c.check("urn:outer", Variant(F.col("w"))).alias("outer")).orderBy("i").collect()
    want = [slow_valid(d) for d in docs]
    assert 20 < sum(want) < len(docs) - 20
    assert [r["ok"] for r in rows] == want
    assert [not r["e"] for r in rows] == want
    assert [r["outer"] for r in rows] == [slow_valid(d, 2) for d in docs]


def test_recursive_plans_do_not_grow_with_documents(spark):
    c = Compiler(Registry([SELF]))
    plan = lambda depth: len(str(Compiler(Registry([SELF]), max_depth=depth).check("urn:self", Variant(F.col("d")))))
    assert plan(90) < 1.02 * plan(10)
    wide = {"n": 1, "kids": [{"n": i, "a": {"n": 0}} for i in range(3000)] + [{"n": -1}]}
    df = spark.createDataFrame([(json.dumps(wide),)], "j string").select(F.parse_json("j").alias("d"))
    assert [r["path"] for r in df.select(F.explode(c.errors("urn:self", Variant(F.col("d"))))).select("col.*").collect()] == ["/kids/3000/n"]


def test_recursive_schemas_with_dynamic_scope_and_unevaluated_keys(spark):
    tree = {"$id": "urn:tree", "$dynamicAnchor": "node", "type": "object", "properties": {"v": {}, "kids": {"items": {"$dynamicRef": "#node"}}}}
    strict = {"$id": "urn:strict", "$dynamicAnchor": "node", "$ref": "urn:tree", "unevaluatedProperties": False}
    c = Compiler(Registry([tree, strict]))
    docs = ['{"kids": [{"v": 1, "kids": [{"v": 2}]}]}', '{"kids": [{"v": 1, "kids": [{"w": 2}]}]}', '{"kids": [{"z": 1}]}', '{"z": 1}']
    df = spark.createDataFrame([(d,) for d in docs], "j string").select("j", F.parse_json("j").alias("d"))
    v = Variant(F.col("d"))
    got = {r["j"]: (r["a"], r["b"], r["e"]) for r in df.select("j", c.check("urn:strict", v).alias("a"), c.check("urn:tree", v).alias("b"), F.transform(c.errors("urn:strict", v), lambda e: e["path"]).alias("e")).collect()}
    assert [got[d] for d in docs] == [(True, True, []), (False, True, ["/kids/0/kids/0"]), (False, True, ["/kids/0"]), (False, True, [""])]


def test_typed_columns_are_followed_as_deep_as_their_type(spark):
    c = Compiler(Registry([SELF]))
    df = spark.createDataFrame([(1, (2, (3, None))), (1, (2, (-3, None))), (1, None)], "n int, a struct<n:int,a:struct<n:int,a:struct<n:int>>>")
    assert [r[0] for r in df.select(c.check("urn:self", row_value(df))).collect()] == [True, False, True]


def test_comparisons_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("CAST(id AS double) AS x", "CAST(id AS int) AS n", "CAST(id AS string) AS s").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")

    def pushed(schema):
        out = is_valid(df, Compiler(Registry([{"$id": "urn:p", "type": "object"} | schema])), "urn:p")
        plan = out._jdf.queryExecution().executedPlan().toString()
        return plan.split("PushedFilters: [")[1].split("], ReadSchema")[0], out.count()

    cases = [
        ({"properties": {"x": {"type": "number", "exclusiveMinimum": 3}}}, "GreaterThan(x,3.0)", 6),
        ({"properties": {"n": {"maximum": 4, "type": "integer"}}}, "LessThanOrEqual(n,4)", 5),
        ({"properties": {"s": {"enum": ["1", "2"], "maxLength": 5}}}, "In(s, [1,2])", 2),
        ({"properties": {"s": {"const": "7"}}}, "EqualTo(s,7)", 1),
        ({"anyOf": [{"properties": {"x": {"maximum": 1}}}, {"properties": {"n": {"minimum": 8}}}]}, "GreaterThanOrEqual(n,8)", 4),
        ({"allOf": [{"properties": {"x": {"minimum": 5}}}], "required": ["s"]}, "IsNotNull(s)", 5),
    ]
    for schema, filter_, n in cases:
        text, rows = pushed(schema)
        assert filter_ in text and rows == n, (schema, text, rows)


def test_a_reference_to_the_same_node_is_valid(spark):
    c = Compiler(Registry([{"$id": "urn:c", "type": "integer", "allOf": [{"$ref": "urn:c"}]}]))
    df = spark.createDataFrame([("1",), ("\"x\"",)], "j string").select(F.parse_json("j").alias("d"))
    assert [r[0] for r in df.select(c.check("urn:c", Variant(F.col("d")))).collect()] == [True, False]


def test_recursive_errors_are_those_of_the_plain_schema(spark):
    """Documents of one level under a schema that refers to itself, and under the same one without that."""
    plain = {
        "$id": "urn:plain", "type": "object", "required": ["n"], "patternProperties": {"^x-y": {"type": "integer"}, "^z.$": {"type": "boolean"}},
        "properties": {"n": {"type": ["integer", "null"]}, "m": {"type": "number", "minimum": 2, "multipleOf": 0.5}, "s": {"type": "string", "minLength": 2, "pattern": "^a"}, "e": {"enum": [1, "a", None, {"k": [1]}]}, "o": {"type": "object", "required": ["p"], "properties": {"p": {"maximum": 3}}}},
    }
    itself = plain | {"$id": "urn:itself", "properties": plain["properties"] | {"kids": {"items": {"$ref": "urn:itself"}}}}
    odd = [None, True, 0, 1, 1.0, 1.5, -3, 2.25, 1e300, 10**30, 2**63, "", "a", "ab", "b", [], [1], {}, {"k": [1]}, {"p": 4}, {"p": None}]
    docs = [{"n": 1, k: x} for k in ("n", "m", "s", "e", "o", "x-y", "x-yz", "x", "zz", "zzz", "") for x in odd] + [*odd, {"n": 1, "m": 1, "s": "b", "e": 2, "o": {}, "x-y": "1", "zq": 0}]
    c = Compiler(Registry([plain, itself]))
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string").select("i", F.parse_json("j").alias("d"))
    v = Variant(F.col("d"))
    rows = df.select("i", c.errors("urn:plain", v).alias("a"), c.errors("urn:itself", v).alias("b"), c.check("urn:itself", v).alias("ok")).orderBy("i").collect()
    said = lambda errors: [(e["path"], e["keyword"], e["message"]) for e in errors]
    assert [said(r["b"]) for r in rows] == [said(r["a"]) for r in rows] and [r["ok"] for r in rows] == [not r["a"] for r in rows]
    assert 40 < sum(r["ok"] for r in rows) < len(docs) - 40


def test_recursive_schemas_open_each_value_once(spark, sf):
    """A path that leads nowhere in a variant costs an exception, so members are looked up in a map; and a small table of documents is dealt to several tasks."""
    rows = validation.QUERIES["v_recursive_tree"](spark, sf)
    assert "$[" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.rdd.getNumPartitions() > 1
