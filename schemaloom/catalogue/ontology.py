"""Ontology output and import, transforms, partial documents, schema listings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..onto import emit, importer, viz
from ..onto import graph as SG
from ..operators import shacl
from ..operators import validation as V
from ..operators.quads import OWL, RDF, RDFS, TYPE, XSD
from ..operators.selection import pinned
from ..plans import project as P
from ..plans.registry import Registry
from ..plans.values import Variant
from ..sources.tables import balanced
from . import graphs as G
from .common import EVENT_DOC, Catalogue, compiler, event_docs, table

C = Catalogue()
ID = "urn:example:"
CUSTOMER = G.CUSTOMER | {"required": ["c_custkey"], "properties": G.CUSTOMER["properties"] | {"c_acctbal": {"type": "number", "minimum": 0}, "c_mktsegment": {"enum": ["BUILDING", "MACHINERY", "AUTOMOBILE", "HOUSEHOLD"]}}}
#: The classes of brands in SQL: c of all, and pairs (s, o) of class and superclass.
CLASSES = f"""WITH b AS (SELECT DISTINCT replace(p_brand, '#', '-') AS c FROM part), e AS (SELECT '{ID}' || c AS s, '{ID}Maker-' || right(c, 1) AS o FROM b UNION SELECT '{ID}Maker-' || right(c, 1), '{ID}Brand' FROM b),
  k AS (SELECT s AS c FROM e UNION SELECT '{ID}Brand')"""


def brand_classes(spark, sf_dir) -> list[dict]:
    """A class for each brand of parts, under one for its maker, under one of all: schema-sized, as there are few brands."""
    brands = sorted(r[0].replace("#", "-") for r in table(spark, sf_dir, "part").select("p_brand").distinct().collect())
    tree = [{"$id": ID + "Brand", "type": "object", "properties": {"code": {"type": "string"}}}]
    return tree + [{"$id": ID + a, "allOf": [{"$ref": ID + b}]} for a, b in dict.fromkeys([*((f"Maker-{x[-1]}", "Brand") for x in brands), *((x, f"Maker-{x[-1]}") for x in brands)])]


@C.query(f"{CLASSES} SELECT s, o FROM e")
def o_owl_sub_classes(spark, sf):
    q = emit.owl(Registry(brand_classes(spark, sf))).frame(spark)
    return q.where((F.col("p") == RDFS + "subClassOf") & (F.col("o_kind") == "iri")).select("s", "o")


@C.query(f"{CLASSES} SELECT c AS s, 'Class' AS kind FROM k UNION ALL SELECT '{ID}Brand#code', 'DatatypeProperty'")
def o_owl_terms(spark, sf):
    q = emit.owl(Registry(brand_classes(spark, sf))).frame(spark)
    return q.where((F.col("p") == TYPE) & F.col("o").isin(OWL + "Class", OWL + "DatatypeProperty")).select("s", F.substring_index("o", "#", -1).alias("kind"))


@C.query(f"{CLASSES} SELECT c AS schema_id, (c <> '{ID}Brand')::INTEGER AS n_parents FROM k")
def o_owl_import(spark, sf):
    """Schemas to an ontology and back."""
    r = Registry(importer.import_owl(emit.owl(Registry(brand_classes(spark, sf))).frame(spark)).schemas.values())
    return spark.createDataFrame([(k, len(r.parents(k))) for k in r], "schema_id string, n_parents int")


@C.query(f"""SELECT '{G.EX}customer/' || c_custkey AS focus_node, 'MinInclusive' AS component FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT '{G.EX}customer/' || c_custkey, 'In' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD')""")
def o_shacl_from_schema(spark, sf):
    """Shapes made from a schema judge the quads of a table."""
    shapes = emit.shacl(Registry([G.KEY, CUSTOMER])).frame(spark)
    out = shacl.validate(shapes, G.customers(spark, sf))
    return out.select("focus_node", F.regexp_extract("component", r"#(\w+)ConstraintComponent$", 1).alias("component"))


@C.query(f"{CLASSES} SELECT s AS source, o AS target, 'subClassOf' AS kind FROM e")
def o_viz_edges(spark, sf):
    return viz.edges(Registry(brand_classes(spark, sf)), spark)


@C.query(f"{CLASSES} SELECT c AS schema_id, CASE WHEN c = '{ID}Brand' THEN 3 ELSE 2 END AS n FROM k")
def o_schema_nodes(spark, sf):
    """Sub-schemas of each schema as rows."""
    first, *others = brand_classes(spark, sf)
    nodes = Registry([*others, first | {"$defs": {"x": {"type": "string"}}}]).nodes(spark)
    return nodes.groupBy("schema_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@C.query(f"{CLASSES} SELECT s AS source, 'subClassOf' AS kind, o AS target FROM e UNION ALL SELECT '{ID}sale', 'range', '{ID}Brand' UNION ALL SELECT '{ID}sale', 'required', '{ID}sale#of'")
def o_relations(spark, sf):
    r = Registry([*brand_classes(spark, sf), {"$id": ID + "sale", "required": ["of"], "properties": {"of": {"$ref": ID + "Brand"}}}])
    return r.relations(spark).where(~F.col("kind").startswith("has ")).select("source", "kind", "target")


@C.query(f"{CLASSES} SELECT c AS schema_id, x.p AS pointer, x.up AS parent, x.d AS depth FROM k, (VALUES ('', NULL, 0, 2), ('/properties/code', '', 1, 0), ('/allOf/0', '', 1, 1)) x(p, up, d, sub) WHERE x.sub = 2 OR x.sub = (c <> '{ID}Brand')::INTEGER")
def o_schema_tree(spark, sf):
    return Registry(brand_classes(spark, sf)).tree(spark).select("schema_id", "pointer", "parent", "depth")


@C.query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, year(o_orderdate)::INTEGER AS y FROM orders")
def t_transform_decode(spark, sf):
    """A transform decodes wherever its schema is referred to."""
    r = Registry([{"$id": ID + "day", "type": "string", "format": "date"}, {"$id": ID + "o", "type": "object", "properties": {"day": {"$ref": ID + "day"}}}])
    r.add_transform(ID + "day", lambda c: F.to_date(c), lambda c: F.date_format(c, "yyyy-MM-dd"))
    df = table(spark, sf, "orders").select("o_orderkey", F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).alias("doc"))
    made = P.Projector(r).project(ID + "o", V.row_value(df, "doc"))
    return df.select("o_orderkey", made["day"].alias("day")).withColumn("y", F.year("day"))


@C.query(f"SELECT event_id, '{{\"k\":' || k || '}}' AS dumped FROM (SELECT event_id, TRY_CAST(({EVENT_DOC})::JSON->>'$.k' AS BIGINT) AS k FROM events) WHERE k IS NOT NULL")
def t_dump_include(spark, sf):
    p = P.Projector(Registry([{"$id": ID + "d", "type": "object", "properties": {"k": {"type": "integer"}, "z": {"type": "integer"}}}]), defaults=False)
    docs = event_docs(spark, sf).select("event_id", p.project(ID + "d", Variant(F.col("doc"))).alias("x")).where("x.k IS NOT NULL")
    from ..plans.values import Typed

    return docs.select("event_id", P.dump(Typed(F.col("x"), docs.schema["x"].dataType), include=["k"], exclude=["k"]).alias("dumped"))


@C.query("SELECT n_nationkey, n_regionkey > 2 AS valid FROM nation")
def v_range_schema(spark, sf):
    """rdfs:range: a record must satisfy the range's schema."""
    c = compiler({"$id": ID + "big", "properties": {"key": {"exclusiveMinimum": 2}}}, {"$id": ID + "n", "properties": {"r": {"rdfs:range": ID + "big"}}})
    df = table(spark, sf, "nation").select("n_nationkey", F.struct(F.struct(F.col("n_regionkey").alias("key")).alias("r")).alias("doc"))
    return df.select("n_nationkey", c.check(ID + "n", V.row_value(df, "doc")).alias("valid"))


@C.query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind FROM part WHERE p_size BETWEEN 1 AND 50")
def v_discriminated_union(spark, sf):
    from ..plans import compose

    large = {"$id": ID + "large", "properties": {"kind": {"const": "large"}, "p_size": {"exclusiveMinimum": 25}}}
    small = {"$id": ID + "small", "properties": {"kind": {"const": "small"}, "p_size": {"maximum": 25, "minimum": 1}}}
    c = compiler(large, small, compose.discriminated_union([large, small], "kind", ID + "part"))
    df = table(spark, sf, "part").select("p_partkey", "p_size", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("kind"))
    return V.is_valid(df, c, ID + "part").select("p_partkey", "kind")



@C.query(f"""SELECT '{ID}nation/' || n_nationkey AS schema_id, CASE n_nationkey % 5
  WHEN 0 THEN '[{{"$ref":"' || r || '"}},{{"oneOf":[{{"$ref":"{ID}A"}},{{"$ref":"' || r || '"}}]}}]'
  WHEN 1 THEN '[{{"not":{{"allOf":[{{"$ref":"' || r || '"}},{{"$ref":"{ID}A"}}]}}}}]'
  WHEN 2 THEN '[{{"properties":{{"name":{{"const":"' || n_name || '"}}}},"required":["name"]}}]'
  WHEN 3 THEN '[{{"enum":["' || n_name || '","other"]}}]'
  ELSE '[{{"oneOf":[{{"allOf":[{{"$ref":"{ID}A"}},{{"not":{{"$ref":"' || r || '"}}}}]}},{{"$ref":"' || r || '"}}]}}]' END AS all_of
  FROM (SELECT *, '{ID}region/' || n_regionkey AS r FROM nation)""")
def o_class_expressions(spark, sf_dir):
    """Nations as classes of anonymous unions, intersections, complements, enumerations and restrictions of their regions, imported as schemas."""
    n = table(spark, sf_dir, "nation")
    c, r, k = F.concat(F.lit(ID + "nation/"), F.col("n_nationkey").cast("string")), F.concat(F.lit(ID + "region/"), F.col("n_regionkey").cast("string")), F.col("n_nationkey") % 5
    b = lambda x: F.concat(F.lit("_:" + x), F.col("n_nationkey").cast("string"))
    a, nil = F.lit(ID + "A"), F.lit(RDF + "nil")

    def quad(s, p, o, kind=None):
        return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), (F.lit(kind) if kind else F.when(o.startswith("_:"), "bnode").otherwise("iri")).alias("o_kind"), F.lit(XSD + "string" if kind else None).cast("string").alias("o_datatype"))

    def chain(name, *items, kind=None):
        return [q for i, x in enumerate(items) for q in (quad(b(f"{name}{i}_"), RDF + "first", x, kind), quad(b(f"{name}{i}_"), RDF + "rest", b(f"{name}{i + 1}_") if i + 1 < len(items) else nil))]

    sub, inter, union, complement = RDFS + "subClassOf", OWL + "intersectionOf", OWL + "unionOf", OWL + "complementOf"
    cases = [
        [quad(c, inter, b("l0_")), *chain("l", r, b("u")), quad(b("u"), union, b("m0_")), *chain("m", a, r)],
        [quad(c, sub, b("x")), quad(b("x"), complement, b("y")), quad(b("y"), inter, b("l0_")), *chain("l", r, a)],
        [quad(c, OWL + "equivalentClass", b("x")), quad(b("x"), OWL + "onProperty", F.lit(ID + "p#name")), quad(b("x"), OWL + "hasValue", F.col("n_name"), "literal")],
        [quad(c, sub, b("x")), quad(b("x"), OWL + "oneOf", b("l0_")), *chain("l", F.col("n_name"), F.lit("other"), kind="literal")],
        [quad(c, sub, b("x")), quad(b("x"), union, b("l0_")), *chain("l", b("y"), r), quad(b("y"), inter, b("m0_")), *chain("m", a, b("z")), quad(b("z"), complement, r)],
    ]
    told = F.array(quad(c, TYPE, F.lit(OWL + "Class")))
    for i, case in enumerate(cases):
        told = F.when(k == i, F.concat(F.array(quad(c, TYPE, F.lit(OWL + "Class"))), F.array(*case))).otherwise(told)
    got = importer.import_owl(n.select(F.explode(told).alias("q")).select("q.*"))
    rows = [(key, json.dumps(s["allOf"], sort_keys=True, separators=(",", ":"))) for key, s in got.schemas.items()]
    return spark.createDataFrame(rows, "schema_id string, all_of string")


def part_schemas(spark, sf_dir):
    """A catalogue of as many schema documents as there are parts, as text."""
    k = F.col("p_partkey").cast("string")
    brand = F.to_json(F.struct(F.col("p_brand").alias("const")))
    text = F.concat(
        F.lit('{"type":"object","$id":"urn:part/'), k, F.lit('","required":["size","brand"],"properties":{"size":{"minimum":1,"maximum":'), F.col("p_size").cast("string"), F.lit('},"brand":'), brand,
        F.lit(',"next":{"$ref":"urn:part/'), (F.col("p_partkey") + 1).cast("string"), F.lit('"},"all":{"type":"array","items":{"$ref":"#"}}},"anyOf":[true,{"minProperties":1}]}'),
    )
    return balanced(table(spark, sf_dir, "part")).select(F.concat(F.lit("urn:part/"), k).alias("id"), F.parse_json(text).alias("body"))


@C.query("""SELECT 'urn:part/' || p_partkey AS schema_id, '{"$id":"urn:part/' || p_partkey || '","anyOf":[true,{"minProperties":1}],"properties":{"all":{"items":{"$ref":"#"},"type":"array"},"brand":{"const":"' || p_brand || '"},"next":{"$ref":"urn:part/'
  || (p_partkey + 1) || '"},"size":{"maximum":' || p_size || ',"minimum":1}},"required":["size","brand"],"type":"object"}' AS body FROM part""")
def o_to_schema(spark, sf_dir):
    """Documents as quads, and the quads as documents again."""
    return SG.to_schema(pinned(SG.schema_quads(part_schemas(spark, sf_dir), "id", "body")))


@C.query("""SELECT x.p AS property, 'urn:part/' || p_partkey AS class, CASE x.p WHEN 'next' THEN 'urn:part/' || (p_partkey + 1) ELSE 'urn:part/' || p_partkey END AS range FROM part, (VALUES ('next'), ('all')) x(p)""")
def o_schema_ranges(spark, sf_dir):
    return SG.ranges(pinned(SG.schema_quads(part_schemas(spark, sf_dir), "id", "body")))


@C.query("""SELECT 'urn:part/' || p_partkey AS class, x.p AS property, CASE x.p WHEN 'size' THEN p_size WHEN 'brand' THEN length(p_brand) ELSE 0 END::INTEGER AS said, CASE x.p WHEN 'size' THEN 0 WHEN 'brand' THEN 1 END::INTEGER AS place
  FROM part, (VALUES ('size'), ('brand'), ('next'), ('all')) x(p)""")
def o_schema_properties(spark, sf_dir):
    """Where each property is declared, what its schema says, and its place among the required ones."""
    q = pinned(SG.schema_quads(part_schemas(spark, sf_dir), "id", "body"))
    said = SG.keywords(q).where(F.col("keyword").isin("maximum", "const")).select("node", F.when(F.col("keyword") == "const", F.length("value") - 2).otherwise(F.col("value").cast("int")).alias("said"))
    required = SG.listed(q, "required").select(F.col("node").alias("class"), F.col("item").alias("property"), F.col("idx").alias("place"))
    return SG.domains(q).join(said, "node", "left").join(required, ["class", "property"], "left").select("class", "property", F.coalesce("said", F.lit(0)).alias("said"), "place")


QUERIES, SQL = C.queries, C.sql
