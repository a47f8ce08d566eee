"""Schema documents as quads and back."""

import json

import pytest
from pyspark.sql import functions as F

from schemaloom.catalogue import graphs, ontology
from schemaloom.functions.rounds import rounds
from schemaloom.onto import graph as G
from schemaloom.plans.registry import subschemas

ODD = {
    "$id": "urn:odd", "$defs": {"a/b~c": {"type": ["string", "null"]}, "": True}, "properties": {"a\"b": {"$ref": "#/$defs/a~1b~0c"}, "list": {"items": {"$ref": "urn:x"}, "prefixItems": [{}, False, {"const": {"properties": {"x": 1}}}]}},
    "additionalProperties": False, "required": ["z", "a\"b"], "enum": [1, None, {"items": []}], "anyOf": [], "patternProperties": {}, "not": {"if": True, "then": {"not": {"minimum": 1.5}}},
}
SCHEMAS = [*graphs.REGISTRY, graphs.BASKET, graphs.ENTRY, ODD, {"$id": "urn:empty"}]


@pytest.fixture(scope="module")
def quads(spark):
    df = spark.createDataFrame([(s["$id"], json.dumps(s)) for s in SCHEMAS] + [("urn:none", None)], "id string, body string").select("id", F.parse_json("body").alias("body"))
    return G.schema_quads(df, "id", "body").cache()


def test_documents_come_back(quads):
    got = {r["schema_id"]: json.loads(r["body"]) for r in G.to_schema(quads).collect()}
    assert got == {s["$id"]: s for s in SCHEMAS}


def test_nodes_and_navigation(quads):
    nodes = {(s["$id"], p) for s in SCHEMAS for p, _ in subschemas(s)}
    assert {(r["o"], r["s"][len(r["o"]) + 1 :]) for r in quads.where(F.col("p") == G.ROOT).collect()} == nodes
    of = {(r["parent"], r["keyword"], r["key"], r["index"], r["child"]) for r in G.children(quads).where("parent LIKE 'urn:odd%'").collect()}
    assert ("urn:odd", "$defs", "a/b~c", None, "urn:odd#/$defs/a~1b~0c") in of and ("urn:odd#/properties/list", "prefixItems", None, 1, "urn:odd#/properties/list/prefixItems/1") in of
    assert len(of) == len([1 for p, _ in subschemas(ODD) if p])
    assert {(r["property"], r["range"]) for r in G.ranges(quads).where("class = 'urn:odd'").collect()} == {('a"b', "urn:odd#/$defs/a~1b~0c"), ("list", "urn:x")}
    assert [r["item"] for r in G.listed(quads, "required").where("node = 'urn:odd'").orderBy("idx").collect()] == ["z", 'a"b']
    assert {r["class"] for r in G.domains(quads).where("property = 'c_name'").collect()} == {graphs.CUSTOMER["$id"]}


def test_steps_are_taken_while_there_is_something_to_do(spark):
    """Each step once, none after the end, and no more than asked for."""
    left, taken = [0, 1, 4, 5, 12, 13, 30, 99], 29
    state = F.struct(F.col("n").alias("left"), F.array().cast("array<int>").alias("seen"))
    step = lambda s: F.struct((s["left"] - 1).alias("left"), F.concat(s["seen"], F.array(s["left"])).alias("seen"))
    df = spark.createDataFrame([(n,) for n in left], "n int").select("n", rounds(state, lambda s: s["left"] > 0, step, taken).alias("end"))
    assert {r["n"]: (r["end"]["left"], r["end"]["seen"]) for r in df.collect()} == {n: (max(0, n - taken), list(range(n, max(0, n - taken), -1))) for n in left}


def test_documents_are_dealt_out(spark, sf):
    """A table in one row group is read by one task; making quads of its documents isn't left to that."""
    assert ontology.part_schemas(spark, sf).rdd.getNumPartitions() > 1
