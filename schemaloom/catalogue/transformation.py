"""Value transformation: coercion, defaults, projections, differences, dumps, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import PRIME, START, hash_column
from ..operators import validation as V
from ..operators.identity import structural_duplicates
from ..operators.validation import row_value
from ..plans import project as P
from ..plans.registry import Registry
from ..plans.values import Typed, Variant
from ..sources.tables import balanced
from .common import EVENT_DOC, Catalogue, compiler, event_docs, table

C = Catalogue()
ID = "urn:example:"
DOC = {
    "$id": ID + "doc",
    "type": "object",
    "required": ["k"],
    "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 100, "ext:alias": "key"}, "z": {"type": "integer", "default": 9}, "b": {"type": "array", "items": {"type": "string"}}, "n_1": {"type": "string"}},
}
D = f"(SELECT event_id, ({EVENT_DOC})::JSON AS d FROM events)"
K = "CASE WHEN list_contains(json_keys(d), 'k') THEN TRY_CAST(d->>'$.k' AS BIGINT) ELSE TRY_CAST(d->>'$.key' AS BIGINT) END"
B = "CASE WHEN json_type(d, '$.b') = 'ARRAY' THEN '1,2,2' END"


def _projected(spark, sf_dir, coerce: bool, defaults: bool):
    p = P.Projector(Registry([DOC]), coerce=coerce, defaults=defaults)
    out = p.project_column(event_docs(spark, sf_dir), ID + "doc", "doc", "x")
    return out.select("event_id", F.col("x.k").alias("k"), F.col("x.z").alias("z"), F.array_join("x.b", ",").alias("b"), F.col("x.n_1").alias("n_1"))


@C.query(f"SELECT event_id, {K} AS k, TRY_CAST(d->>'$.z' AS BIGINT) AS z, {B} AS b, d->>'$.n_1' AS n_1 FROM {D}")
def t_convert(spark, sf_dir):
    return _projected(spark, sf_dir, True, False)


@C.query("""SELECT o_orderkey, upper(o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END) AS label, CASE o_orderkey % 3 WHEN 0 THEN o_custkey * 100 WHEN 1 THEN o_custkey END AS cents,
  upper(o_orderpriority) AS extra, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE upper(o_orderpriority) END AS tag, upper(o_orderstatus) || ',' || lower(o_orderstatus) AS pair FROM orders""")
def t_decode_branches(spark, sf_dir):
    """References decoded within anyOf, oneOf, conditions, additional properties and items at the front, each row by the branch that it meets."""
    r = Registry([{"$id": ID + "Upper", "type": "string", "pattern": "."}, {"$id": ID + "Lower", "type": "string"}, {"$id": ID + "Cents", "type": "integer", "minimum": 0}])
    r.transforms |= {ID + "Upper": (F.upper, F.lower), ID + "Lower": (F.lower, F.upper), ID + "Cents": (lambda c: c * 100, lambda c: c / 100)}
    ref = lambda n: {"$ref": ID + n}
    r.set({
        "$id": ID + "order", "type": "object",
        "properties": {
            "label": {"anyOf": [{"type": "null"}, ref("Upper")]}, "price": {"oneOf": [{"type": "null"}, {"allOf": [{"type": "integer"}, {"maximum": -1}], "type": "integer"}, ref("Cents")]},
            "more": {"type": "object", "additionalProperties": ref("Upper")}, "tag": {"if": {"pattern": "^even"}, "then": ref("Lower"), "else": ref("Upper")},
            "pair": {"type": "array", "prefixItems": [ref("Upper"), ref("Lower")]},
        },
    })
    even = F.col("o_orderkey") % 2 == 0
    label = F.concat(F.lower("o_orderstatus"), F.when(even, F.lower("o_orderpriority")).otherwise(""))
    price = F.expr("CASE o_orderkey % 3 WHEN 0 THEN o_custkey WHEN 1 THEN -1 - o_custkey END")
    tag = F.concat(F.when(even, "even ").otherwise("odd "), "o_orderpriority")
    doc = F.struct(label.alias("label"), price.alias("price"), F.create_map(F.lit("x"), "o_orderpriority").alias("more"), tag.alias("tag"), F.array("o_orderstatus", "o_orderstatus").alias("pair"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.parse_json(F.to_json(doc)).alias("doc"))
    out = P.Projector(r, coerce=False).project_column(df, ID + "order", "doc", "x")
    cents = F.when(F.col("x.price") < 0, -1 - F.col("x.price")).otherwise(F.col("x.price"))
    return out.select("o_orderkey", F.col("x.label").alias("label"), cents.alias("cents"), F.col("x.more")["x"].alias("extra"), F.regexp_replace("x.tag", "^(even|ODD) ", "").alias("tag"), F.array_join("x.pair", ",").alias("pair"))


@C.query("SELECT o_orderkey, o_orderstatus AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS b, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS c, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'x' END AS d FROM orders")
def t_merge(spark, sf_dir):
    """Documents, and rows, of which one lies over the other."""
    even, third = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0
    first, second = F.struct(F.col("o_orderstatus").alias("a"), F.col("o_orderstatus").alias("b")), F.struct(F.when(even, F.col("o_orderpriority")).alias("b"), F.when(~third, F.col("o_custkey")).alias("c"))
    df = table(spark, sf_dir, "orders").withColumns({"x": F.parse_json(F.to_json(first)), "y": F.parse_json(F.to_json(second)), "u": F.struct(F.lit("x").alias("d")), "v": F.struct(F.when(even, F.col("o_orderpriority")).alias("d"))})
    m = P.merged(Variant(F.col("x")), Variant(F.col("y")))
    of = lambda k, kind="string": F.try_variant_get(m, f"$.{k}", kind).alias(k)
    typed = P.merged(*(Typed(F.col(c), df.schema[c].dataType) for c in "uv"))
    return df.select("o_orderkey", of("a"), of("b"), of("c", "bigint"), typed["d"].alias("d"))


@C.query(f"""SELECT event_id, '{{' || array_to_string(list_filter([CASE WHEN list_contains(json_keys(d), 'k') OR list_contains(json_keys(d), 'key') THEN '"k":' || {K} END, CASE WHEN list_contains(json_keys(d), 'z') THEN '"z":' || (d->>'$.z') END], lambda x: x IS NOT NULL), ',') || '}}' AS said
  FROM {D} WHERE event_id % 6 IN (0, 2, 5)""")
def t_dump_unset(spark, sf_dir):
    """Values with their defaults, dumped without what their documents didn't say."""
    schema = {"$id": ID + "small", "type": "object", "properties": {"k": {"type": "integer", "ext:alias": "key"}, "z": {"type": "integer", "default": 9}}}
    p = P.Projector(Registry([schema]), coerce=True, defaults=True)
    df = p.project_column(event_docs(spark, sf_dir).where("event_id % 6 IN (0, 2, 5)"), ID + "small", "doc", "x")
    return df.select("event_id", p.dump_json(ID + "small", Typed(F.col("x"), df.schema["x"].dataType), given=Variant(F.col("doc"))).alias("said"))


@C.query("SELECT event_id, 9007199254740993 + event_id AS a, 9007199254740993 + event_id AS b, -9007199254740993 - event_id AS c, 9007199254740993 + event_id AS d FROM events")
def t_convert_longs(spark, sf_dir):
    """Whole numbers beyond 2^53 from a document, from text in one, from a column and without coercion stay as they are."""
    n = F.lit(9007199254740993) + F.col("event_id")
    df = table(spark, sf_dir, "events").select("event_id", n.alias("n"), F.parse_json(F.to_json(F.struct(n.alias("a"), n.cast("string").alias("b"), (-n).alias("c")))).alias("doc"))
    r = Registry([{"$id": ID + "longs", "type": "object", "properties": {x: {"type": "integer"} for x in "abc"}}, {"$id": ID + "n", "properties": {"n": {"type": "integer"}}}])
    out = P.Projector(r).project_column(df, ID + "longs", "doc", "x")
    plain = P.Projector(r, coerce=False).project(ID + "n", row_value(df.select("n")))
    return out.select("event_id", "x.a", "x.b", "x.c", plain["n"].alias("d"))


@C.query(f"SELECT event_id, {K} AS k, coalesce(TRY_CAST(d->>'$.z' AS BIGINT), 9) AS z, {B} AS b, d->>'$.n_1' AS n_1 FROM {D}")
def t_cast_defaults(spark, sf_dir):
    return _projected(spark, sf_dir, True, True)


@C.query(f"SELECT event_id, CASE WHEN json_type(d, '$.k') IN ('UBIGINT', 'BIGINT') THEN TRY_CAST(d->>'$.k' AS BIGINT) END AS k, TRY_CAST(d->>'$.z' AS BIGINT) AS z, CASE WHEN json_type(d, '$.b') = 'ARRAY' THEN '' END AS b, d->>'$.n_1' AS n_1 FROM {D}")
def t_clean(spark, sf_dir):
    """Declared keys only, nothing coerced: the array of numbers holds no strings, so its items are null."""
    return _projected(spark, sf_dir, False, False)


@C.query("SELECT region.r_regionkey, 0::BIGINT AS k, 9::BIGINT AS z FROM region")
def t_create(spark, sf_dir):
    made = P.Projector(Registry([DOC])).create(ID + "doc")
    return table(spark, sf_dir, "region").select("r_regionkey", made["k"].alias("k"), made["z"].alias("z"))


@C.query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def t_computed(spark, sf_dir):
    """A computed field is a Column of the instance's other fields."""
    r = Registry([{"$id": ID + "line", "type": "object", "properties": {"price": {"type": "number"}, "discount": {"type": "number"}}}])
    r.add_computed(ID + "line", "net", lambda v: F.round(v.get("price").number() * (1 - v.get("discount").number()), 4))
    df = balanced(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", F.struct(F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount")).alias("doc"))
    from ..plans.compiler import Compiler

    return V.instantiate(df, Compiler(r), ID + "line", "doc").select("l_orderkey", "l_linenumber", F.col("instance.net").alias("net"))


@C.query(f"SELECT event_id, CASE WHEN {K} BETWEEN 0 AND 100 THEN {K} END AS k, CASE WHEN {K} BETWEEN 0 AND 100 THEN true ELSE false END AS valid FROM {D}")
def t_instantiate(spark, sf_dir):
    out = V.instantiate(event_docs(spark, sf_dir), compiler(DOC), ID + "doc", "doc", cast=True)
    return out.select("event_id", F.col("instance.k").alias("k"), (F.size("errors") == 0).alias("valid"))


@C.query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '{\"c_custkey\":' || c_custkey || ',\"c_nationkey\":' || c_nationkey || '}' ELSE '{\"c_custkey\":' || c_custkey || ',\"c_nationkey\":' || c_nationkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}' END AS dumped FROM customer")
def t_dump_filters(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", P.dump(V.row_value(df), exclude=["c_name", "c_acctbal"], exclude_defaults={"c_mktsegment": "BUILDING"}).alias("dumped"))


@C.query("""SELECT a.p_partkey, x.path, x.op FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1,
  (VALUES ('/p_brand', 'set'), ('/p_size', 'set'), ('/p_type', 'set')) x(path, op)
  WHERE CASE x.path WHEN '/p_brand' THEN a.p_brand <> b.p_brand WHEN '/p_size' THEN a.p_size <> b.p_size ELSE a.p_type <> b.p_type END""")
def t_diff(spark, sf_dir):
    """What makes each part into the next one."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.struct("p_brand", "p_size", "p_type").alias("doc"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("doc").alias("next"))
    both = part.join(after, "p_partkey")
    kind = part.schema["doc"].dataType
    changes = P.diff(Typed(F.col("doc"), kind), Typed(F.col("next"), kind))
    return both.select("p_partkey", F.explode(changes).alias("c")).select("p_partkey", "c.path", "c.op")


@C.query("SELECT a.p_partkey, true AS same FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def t_changeset_apply(spark, sf_dir):
    """Applying a difference gives the other document."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.struct("p_brand", "p_size", "p_type").alias("doc"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("doc").alias("next"))
    both = part.join(after, "p_partkey")
    kind = part.schema["doc"].dataType
    patched = P.apply_changes(F.to_json("doc"), P.diff(Typed(F.col("doc"), kind), Typed(F.col("next"), kind)))
    return both.select("p_partkey", (F.from_json(patched, kind) == F.col("next")).alias("same"))


@C.query("""WITH u AS (SELECT md5(text) AS h, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1)
  SELECT d.doc_id, u.first AS same_as FROM documents d JOIN u ON md5(d.text) = u.h WHERE u.n > 1 AND d.doc_id <> u.first""")
def t_structural_dupes(spark, sf_dir):
    """Documents equal to an earlier one, by hash of the content; the groups are reduced map-side."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(first, "h").where(F.col("doc_id") != F.col("first")).select("doc_id", F.col("first").alias("same_as"))


@C.query("SELECT n_nationkey::VARCHAR AS owner, '/n_regionkey' AS pointer, r_regionkey::VARCHAR AS match FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> r_regionkey")
def t_find_duplicates(spark, sf_dir):
    """Parts of documents that equal a top-level one of another owner."""
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("owner"), F.lit("/n_regionkey").alias("pointer"), F.md5(F.col("n_regionkey").cast("string")).alias("hash"))
    top = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.md5(F.col("r_regionkey").cast("string")).alias("hash"))
    return structural_duplicates(nodes, top)


_HASHED = "'{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}'"
_SIGNED = "CASE WHEN xor(h, c) >= 2147483648 THEN xor(h, c) - 4294967296 ELSE xor(h, c) END"


@C.query(f"""SELECT c_custkey, printf('%x', list_reduce(list_prepend({START}::BIGINT, list_transform(string_split({_HASHED}, ''), lambda u: unicode(u)::BIGINT)),
  lambda h, c: CAST(CAST({_SIGNED} AS DOUBLE) * {PRIME} AS BIGINT) & 4294967295)) AS hash FROM customer""")
def t_value_hash(spark, sf_dir):
    """Content hashes that equal the reference's bit for bit."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return df.select("c_custkey", hash_column(V.row_value(df).canonical()).alias("hash"))


@C.query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE 1 END::BIGINT AS k FROM events")
def t_alias(spark, sf_dir):
    """A key under its alias, where the key itself is absent."""
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"key": '), F.col("user_id").cast("string"), F.lit("}"))).otherwise('{"k": 1, "key": 2}')
    df = table(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("doc"))
    return df.select("event_id", P.Projector(Registry([DOC]), defaults=False).project(ID + "doc", Variant(F.col("doc")))["k"].alias("k"))


DAY = {"$id": ID + "day", "type": "string", "format": "date"}
ITEM = {"$id": ID + "item", "type": "object", "properties": {"part": {"type": "integer"}, "note": {"type": "string", "default": "none"}, "due": {"$ref": DAY["$id"]}}}
SALE = {"$id": ID + "sale", "type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "day": {"$ref": DAY["$id"]}, "items": {"type": "array", "items": {"$ref": ITEM["$id"]}}}}


def dated() -> Registry:
    r = Registry([DAY, ITEM, SALE])
    r.add_transform_chain(DAY["$id"], (lambda c: F.to_date(c), lambda c: F.date_format(c, "yyyy-MM-dd")), (lambda c: F.date_add(c, 1), lambda c: F.date_add(c, -1)))
    return r


def sales(spark, sf_dir):
    """Decoded values: dates, one day on, at the top and in an array."""
    day = F.date_add(F.to_date("o_orderdate"), 1)
    item = F.struct(F.col("o_custkey").alias("part"), F.when(F.col("o_orderkey") % 2 == 0, "none").otherwise("x").alias("note"), day.alias("due"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderkey").alias("id"), day.alias("day"), F.array(item).alias("items")).alias("doc"))


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@C.query(f"""SELECT o_orderkey, '{{"id":' || o_orderkey || ',"day":"' || {_DAY} || '","items":[{{"part":' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ',"note":"x"' END || ',"due":"' || {_DAY} || '"}}]}}' AS dumped FROM orders""")
def t_dump_json(spark, sf_dir):
    """Encoders through references and arrays, and defaults left out at each level."""
    df = sales(spark, sf_dir)
    return df.select("o_orderkey", P.Projector(dated()).dump_json(SALE["$id"], V.row_value(df, "doc"), exclude_defaults=True).alias("dumped"))


@C.query(f"SELECT o_orderkey, {_DAY} AS day, {_DAY} AS due FROM orders")
def t_encode(spark, sf_dir):
    df = sales(spark, sf_dir)
    return df.select("o_orderkey", P.Projector(dated()).encode(SALE["$id"], V.row_value(df, "doc")).alias("x")).select("o_orderkey", F.col("x.day").alias("day"), F.col("x.items")[0]["due"].alias("due"))


@C.query(f"SELECT event_id, CASE WHEN json_type(d, '$.k') IN ('UBIGINT', 'BIGINT') THEN CAST(d->>'$.k' AS BIGINT) ELSE 0 END AS k, coalesce(TRY_CAST(d->>'$.z' AS BIGINT), 9) AS z, d->>'$.n_1' AS n_1 FROM {D}")
def t_materialize(spark, sf_dir):
    """Partial documents: every declared key, defaults, and an empty value for the required one."""
    c = compiler({**DOC, "properties": {**DOC["properties"], "k": {"type": "integer"}}})
    out = V.materialize(event_docs(spark, sf_dir), c, ID + "doc", "doc", partial=True)
    return out.select("event_id", "instance.k", "instance.z", "instance.n_1")


@C.query(f"SELECT event_id, CASE WHEN json_type(d, '$.k') IN ('UBIGINT', 'BIGINT') THEN CAST(d->>'$.k' AS BIGINT) END AS k, TRY_CAST(d->>'$.key' AS DOUBLE)::VARCHAR IS NOT NULL AS has_key FROM {D}")
def t_strict(spark, sf_dir):
    """A strict property is taken as it is where others are coerced."""
    r = Registry([{"$id": ID + "s", "type": "object", "properties": {"k": {"type": "integer", "ext:strict": True}, "key": {"type": "string"}}}])
    out = event_docs(spark, sf_dir).select("event_id", P.Projector(r).project(ID + "s", Variant(F.col("doc"))).alias("x"))
    return out.select("event_id", "x.k", F.col("x.key").isNotNull().alias("has_key"))


QUERIES, SQL = C.queries, C.sql
