"""Ontology round trips, loaders, artefacts, composition and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from schemaloom import cli
from schemaloom.functions.hashing import hash_text, number_text, structural_hash, value_hash
from schemaloom.onto import emit, importer, viz
from schemaloom.operators import shacl
from schemaloom.operators.jsonld import from_jsonld
from schemaloom.operators.quads import Emitter, lists
from schemaloom.operators.validation import is_valid, row_value
from schemaloom.plans import compose
from schemaloom.plans.compiler import KEPT, Compiler
from schemaloom.plans.project import access_path
from schemaloom.plans.registry import Registry
from schemaloom.sources import loaders, tables

B = "https://parts.example/"
SCHEMAS = [
    {"$id": B + "Code", "type": "string", "pattern": "^[0-9]{13}$"},
    {"$id": B + "Status", "enum": ["inStock", "soldOut"]},
    {"$id": B + "Price", "type": "object", "properties": {"amount": {"type": "number", "minimum": 0}, "currency": {"type": "string"}}, "required": ["amount"]},
    {"$id": B + "Part", "type": "object", "title": "Part", "required": ["code"], "properties": {"code": {"$ref": B + "Code", "inverseFunctional": True}, "price": {"$ref": B + "Price"}, "status": {"$ref": B + "Status"}, "size": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}},
    {"$id": B + "SparePart", "type": "object", "allOf": [{"$ref": B + "Part"}], "disjointWith": B + "Price"},
    {"$id": B + "NotPrice", "not": {"$ref": B + "Price"}},
]


def test_owl_round_trip(spark):
    got = importer.import_owl(emit.owl(Registry(SCHEMAS)).frame(spark))
    assert not got.unsupported
    assert set(got.schemas) == {s["$id"] for s in SCHEMAS}
    assert got.schemas[B + "Code"] == SCHEMAS[0]
    assert got.schemas[B + "Status"]["enum"] == ["inStock", "soldOut"]
    assert got.schemas[B + "SparePart"]["allOf"] == [{"$ref": B + "Part"}]
    assert got.schemas[B + "SparePart"]["disjointWith"] == B + "Price"
    assert got.schemas[B + "NotPrice"]["not"] == {"$ref": B + "Price"}
    part = got.schemas[B + "Part"]
    assert part["required"] == ["code"]
    assert part["title"] == "Part"
    assert part["properties"]["code"] == {"$ref": B + "Code", "inverseFunctional": True}
    assert part["properties"]["price"] == {"$ref": B + "Price"}
    assert part["properties"]["size"] == {"type": "integer"}
    assert part["properties"]["tags"] == {"type": "array", "items": {"type": "string"}}
    assert "SCHEMAS = [" in importer.codegen(got)
    compile(importer.codegen(got), "generated", "exec")


def test_shapes_of_schemas_judge_their_instances(spark):
    r = Registry(SCHEMAS)
    df = spark.createDataFrame([("a", "1234567890123", 5), ("b", "x", 6), ("c", None, 7)], "k string, code string, size int")
    e = Emitter(r)
    q = e.quads(df, B + "Part", F.concat(F.lit(B + "i/"), F.col("k")), row_value(df))
    out = shacl.validate(emit.shacl(r).frame(spark), q)
    assert {(x["focus_node"][-1], x["component"].rpartition("#")[2]) for x in out.collect()} == {("b", "PatternConstraintComponent"), ("c", "MinCountConstraintComponent")}


def test_jsonld_and_lists(spark):
    node = {"@id": "ex:a", "@type": "ex:T", "ex:l": {"@list": [1, "b", {"@id": "ex:c"}]}, "ex:n": {"ex:v": True}}
    q = from_jsonld(spark.createDataFrame([(json.dumps(node),)], "t string").select(F.parse_json("t").alias("d")), "d", F.lit("k"), {"ex": "https://e/"})
    assert [(r["idx"], r["item"]) for r in lists(q).orderBy("idx").collect()] == [(0, "1"), (1, "b"), (2, "https://e/c")]
    assert q.where("o_kind = 'literal' and o = 'true'").count() == 1


def test_quads_are_stored_by_predicate(spark, tmp_path):
    df = spark.createDataFrame([("a", 5), ("b", 6)], "k string, size int")
    q = Emitter(Registry(SCHEMAS)).quads(df, B + "Part", F.col("k"), row_value(df))
    tables.write_quads(q, str(tmp_path / "q"))
    only = tables.read_predicate(spark, str(tmp_path / "q"), B + "Part#size")
    assert sorted(r["o"] for r in only.collect()) == ["5", "6"]
    assert "PartitionFilters: [isnotnull" in only._jdf.queryExecution().executedPlan().toString()


def test_loaders_and_artifacts(tmp_path):
    source = loaders.cached(loaders.compose(loaders.memory({}), loaders.memory({s["$id"]: s for s in SCHEMAS})))
    got = loaders.prefetch(source, [B + "SparePart", "urn:none"])
    assert {s["$id"] for s in got["schemas"]} == {B + n for n in ("SparePart", "Part", "Code", "Price", "Status")}
    assert got["loadResult"]["missing"] == ["urn:none"]
    path = tmp_path / "a.json"
    loaders.save(Registry(SCHEMAS), str(path))
    assert loaders.load(str(path)).values() == SCHEMAS
    path.write_text(path.read_text().replace("soldOut", "gone"))
    with pytest.raises(loaders.LoadError):
        loaders.load(str(path))


def test_semantic_hashes_change_with_what_is_referred_to(spark, tmp_path):
    chain = [{"$id": f"urn:{i}", "properties": {"x": {"$ref": f"urn:{i + 1}"}}} for i in range(4)] + [{"$id": "urn:4", "type": "string", "maxLength": 3}, {"$id": "urn:alone", "type": "integer"}]
    before = Registry([*chain, {"$id": "urn:loop", "properties": {"y": {"$ref": "urn:loop"}, "z": {"$ref": "urn:2"}}}])
    after = Registry(before.values())
    after.set(chain[4] | {"maxLength": 4})
    assert loaders.dependants(before, after) == ["urn:0", "urn:1", "urn:2", "urn:3", "urn:loop", "urn:4"]
    after.set(chain[4] | {"title": "as before"})
    assert loaders.dependants(before, after) == []
    after.set(chain[3] | {"properties": {}})
    assert loaders.dependants(before, after) == ["urn:0", "urn:1", "urn:2", "urn:loop", "urn:3"]
    path = tmp_path / "a.json"
    loaders.save(before, str(path))
    assert loaders.load(str(path)).values() == before.values()
    body = json.loads(path.read_text())
    body["schemas"][4]["schema"]["maxLength"] = 9
    path.write_text(json.dumps(body))
    with pytest.raises(loaders.LoadError, match="urn:4 was changed"):
        loaders.load(str(path))
    body["schemas"][4]["hash"] = structural_hash(body["schemas"][4]["schema"])
    path.write_text(json.dumps(body))
    with pytest.raises(loaders.LoadError, match="urn:0 refers to"):
        loaders.load(str(path))


def test_compiled_rows_are_kept_until_their_meaning_changes(spark):
    df = spark.createDataFrame([("ab",), ("abcd",)], "x string")
    leaf = {"$id": "urn:leaf", "type": "string", "maxLength": 3}
    r = Registry([leaf, {"$id": "urn:root", "properties": {"x": {"$ref": "urn:leaf"}}}, {"$id": "urn:other", "properties": {"x": {"minLength": 3}}}])
    count = lambda key: is_valid(df, Compiler(r), key).count()
    assert (count("urn:root"), count("urn:other")) == (1, 1)
    kept = len(KEPT)
    assert (count("urn:root"), count("urn:other"), len(KEPT)) == (1, 1, kept)
    r.set(leaf | {"maxLength": 1})
    assert (count("urn:root"), count("urn:other"), len(KEPT)) == (0, 1, kept + 1)
    r.add_invariant("urn:root", "never", lambda v: F.lit("no"))
    assert len(Compiler(r).registry.invariants) == 1 and count("urn:root") == 0 and len(KEPT) == kept + 1


def test_composition():
    part = SCHEMAS[3]
    assert compose.pick(part, ["code"], "urn:p") == {"$id": "urn:p", "type": "object", "properties": {"code": part["properties"]["code"]}, "required": ["code"]}
    assert "required" not in compose.omit(part, ["code"], "urn:o")
    assert compose.required(part, "urn:r")["required"] == list(part["properties"])
    assert compose.extend(part, {"properties": {"x": {}}}, "urn:e")["allOf"] == [{"$ref": part["$id"]}, {"properties": {"x": {}}}]
    assert list(Registry([*SCHEMAS, compose.extend(part, {"properties": {"x": {}}}, "urn:e")]).properties("urn:e")) == [*part["properties"], "x"]


def test_hashes_and_texts():
    assert hash_text("") == "811c9dc5"
    assert value_hash({"b": 1, "a": 2}) == value_hash({"a": 2.0, "b": 1.0})
    assert [number_text(x) for x in (1.0, 1e21, 1e-7, 0.000001, 123456789012345680000.0, 0.1, -0.0)] == ["1", "1e+21", "1e-7", "0.000001", "123456789012345680000", "0.1", "0"]
    assert access_path("/a/b/0/x y") == 'a.b[0]["x y"]'


def test_command_line(tmp_path):
    for i, s in enumerate(SCHEMAS):
        (tmp_path / f"{i}.json").write_text(json.dumps(s))
    for kind in ("artifact", "schema", "ontology", "shacl"):
        assert cli.main(["build", kind, str(tmp_path / "[0-9].json"), "--out", str(tmp_path / f"{kind}.out")]) == 0
    assert "@graph" in json.loads((tmp_path / "ontology.out").read_text())
    cli.main(["viz", str(tmp_path / "[0-9].json"), "--out", str(tmp_path / "v.html")])
    assert "Part" in (tmp_path / "v.html").read_text()
    assert viz.type_string(SCHEMAS[2]) == "{ amount: number; currency?: string }"
