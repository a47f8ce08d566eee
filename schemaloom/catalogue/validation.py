"""Validation: one query per keyword, and the error relations and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as V
from ..plans.compiler import FORMAT_VOCABULARY
from ..plans.values import Variant
from ..sources.tables import balanced
from .common import EVENT_DOC, Catalogue, compiler, event_docs, table

C = Catalogue()
ID = "urn:example:"


def _keyword(name: str, source: str, by: str, prop: str, schema: dict, fails: str, keyword: str) -> None:
    """Errors of one keyword of one column, counted by another column."""

    def query(spark, sf_dir):
        c = compiler({"$id": ID + name, "type": "object", "properties": {prop: schema}})
        df = balanced(table(spark, sf_dir, source)).select(by, prop)
        return V.summary(V.error_rows(df, c, ID + name, [by]), by, "path", "keyword")

    C.add(name, query, f"SELECT {by}, '/{prop}' AS path, '{keyword}' AS keyword, count(*) AS n_errors FROM {source} WHERE {fails} GROUP BY {by}")


for _args in (
    ("v_type_integer", "lineitem", "l_returnflag", "l_discount", {"type": "integer"}, "l_discount <> floor(l_discount)", "type"),
    ("v_type_string", "orders", "o_orderstatus", "o_totalprice", {"type": ["string", "boolean"]}, "o_totalprice IS NOT NULL", "type"),
    ("v_enum", "orders", "o_orderpriority", "o_orderstatus", {"enum": ["F", "O"]}, "o_orderstatus NOT IN ('F', 'O')", "enum"),
    ("v_const", "orders", "o_orderstatus", "o_orderpriority", {"const": "1-URGENT"}, "o_orderpriority <> '1-URGENT'", "const"),
    ("v_minimum", "customer", "c_mktsegment", "c_acctbal", {"type": "number", "minimum": 0}, "c_acctbal < 0", "minimum"),
    ("v_maximum", "customer", "c_mktsegment", "c_acctbal", {"maximum": 5000}, "c_acctbal > 5000", "maximum"),
    ("v_exclusive_minimum", "lineitem", "l_linestatus", "l_quantity", {"exclusiveMinimum": 5}, "l_quantity <= 5", "exclusiveMinimum"),
    ("v_exclusive_maximum", "lineitem", "l_linestatus", "l_discount", {"exclusiveMaximum": 0.1}, "l_discount >= 0.1", "exclusiveMaximum"),
    ("v_multiple_of", "lineitem", "l_returnflag", "l_quantity", {"multipleOf": 3}, "abs(l_quantity / 3.0 - floor(l_quantity / 3.0 + 0.5)) > 2.220446049250313e-15", "multipleOf"),
    ("v_multiple_of_decimal", "lineitem", "l_returnflag", "l_discount", {"multipleOf": 0.02}, "abs(l_discount / 0.02::DOUBLE - floor(l_discount / 0.02::DOUBLE + 0.5)) > 2.220446049250313e-15", "multipleOf"),
    ("v_min_length", "documents", "lang", "text", {"minLength": 400}, "length(text) < 400", "minLength"),
    ("v_max_length", "documents", "lang", "text", {"maxLength": 4000}, "length(text) > 4000", "maxLength"),
    ("v_pattern", "part", "p_type", "p_brand", {"pattern": "^Brand#[1-3]"}, "NOT regexp_matches(p_brand, '^Brand#[1-3]')", "pattern"),
    ("v_min_items", "embeddings", "label", "embedding", {"minItems": 65}, "len(embedding) < 65", "minItems"),
    ("v_max_items", "embeddings", "label", "embedding", {"maxItems": 63}, "len(embedding) > 63", "maxItems"),
    ("v_contains", "embeddings", "label", "embedding", {"contains": {"minimum": 0.2}, "minContains": 8}, "len(list_filter(embedding, lambda x: x::DOUBLE >= 0.2)) < 8", "contains"),
    ("v_max_contains", "embeddings", "label", "embedding", {"contains": {"minimum": 0.2}, "minContains": 0, "maxContains": 5}, "len(list_filter(embedding, lambda x: x::DOUBLE >= 0.2)) > 5", "maxContains"),
    ("v_url_scheme", "pages", "page_id", "url", {"format": "uri", "pattern": "^https:"}, "NOT starts_with(url, 'https:')", "pattern"),
):
    _keyword(*_args)

# For each format, texts and whether they are of it.
FORMAT_CASES = {
    "date": {"2024-02-29": 1, "2023-02-29": 0, "2024-1-01": 0, "2024-13-01": 0, "1999-12-31": 1},
    "date_time": {"2024-02-29T12:00:00Z": 1, "2024-02-29T12:00:00": 0, "2024-02-29t23:59:60.5+99:99": 1, "2024-02-30T12:00:00Z": 0, "2024-02-29 12:00:00Z": 0},
    "time": {"12:00:00": 1, "12:00:00Z": 0, "24:00:00": 0, "23:59:60.25": 1},
    "duration": {"P1D": 1, "PT5M": 1, "P": 0, "1D": 0, "P1Y2M3DT4H5M6S": 1},
    "email": {"a@b.co": 1, "@b.co": 0, "a@b": 0, "a b@c.de": 0, "a@b.": 0, "x@.c": 0},
    "hostname": {"example.com": 1, "-a.com": 0, "a..b": 0, "localhost": 1},
    "ipv4": {"1.2.3.4": 1, "01.2.3.4": 0, "256.1.1.1": 0, "1.2.3": 0},
    "ipv6": {"::1": 1, "fe80::1": 1, "2001:db8:85a3:0:0:8a2e:370:7334": 1, "1::2::3": 0, "12345::": 0, "::ffff:192.0.2.1": 1},
    "uuid": {"123e4567-e89b-12d3-a456-426614174000": 1, "123e4567e89b12d3a456426614174000": 0, "123e4567-e89b-02d3-a456-426614174000": 0, "123e4567-e89b-12d3-c456-426614174000": 0},
    "uri": {"https://example.com/a?b#c": 1, "urn:isbn:1": 1, "/relative": 0, "https://": 0, "no scheme": 0},
    "json_pointer": {"/a/b": 1, "a": 0, "/a~0~1": 1, "/a~2": 0},
    "byte": {"YWJj": 1, "YWJ": 0, "YW==": 1, "Y===": 0},
    "binary": {"00ff": 1, "0f0": 0, "xyz0": 0},
    "regex": {"^a+$": 1, "(": 0},
}


def _format(name: str, cases: dict[str, int]) -> None:
    texts = list(cases)
    pick = "CASE " + " ".join(f"WHEN event_id % {len(texts)} = {i} THEN '{t}'" for i, t in enumerate(texts)) + " END"

    def query(spark, sf_dir):
        c = compiler({"$id": ID + name, "properties": {"text": {"type": "string", "format": name.replace("_", "-")}}})
        df = table(spark, sf_dir, "events").select(F.expr(pick).alias("text"))
        row = V.row_value(df)
        return df.groupBy("text", c.check(ID + name, row).alias("valid")).agg(F.count(F.lit(1)).alias("n"))

    known = ", ".join(f"('{t}', {bool(v)})" for t, v in cases.items())
    C.add(f"v_format_{name}", query, f"SELECT v.t AS text, v.ok AS valid, count(*) AS n FROM events e JOIN (VALUES {known}) v(t, ok) ON {pick} = v.t GROUP BY 1, 2")


for _name, _cases in FORMAT_CASES.items():
    if _name != "uri":
        _format(_name, _cases)
_format("uri", FORMAT_CASES["uri"])


#: Columns and texts made of columns, some spoiled by row: format, table, key, text, and whether it is of the format, told without a pattern of it.
COLUMN_FORMATS = (
    ("uri", "pages", "page_id", "CASE WHEN page_id % 3 = 0 THEN substr(url, locate('://', url)) ELSE url END", "page_id % 3 <> 0"),
    ("hostname", "pages", "page_id", "concat(CASE WHEN page_id % 4 = 1 THEN '-' ELSE '' END, regexp_extract(url, '://([^/?#]*)', 1))", "page_id % 4 <> 1"),
    ("date", "orders", "o_orderkey", "concat(date_format(o_orderdate, 'yyyy-MM-'), lpad(o_orderkey % 31 + 1, 2, '0'))", "o_orderkey % 31 + 1 <= day(last_day(o_orderdate))"),
    ("date-time", "orders", "o_orderkey", "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T', lpad(o_custkey % 26, 2, '0'), ':30:00', CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE '' END)", "o_custkey % 26 < 24 AND o_orderkey % 2 = 0"),
    ("time", "lineitem", "l_orderkey", "concat(lpad(l_partkey % 30, 2, '0'), ':', lpad(l_suppkey % 70, 2, '0'), ':', lpad(l_linenumber * 9, 2, '0'))", "l_partkey % 30 < 24 AND l_suppkey % 70 < 60 AND l_linenumber * 9 < 60"),
    ("ipv4", "lineitem", "l_orderkey", "concat_ws('.', l_partkey % 300, l_suppkey % 300, l_linenumber, CAST(l_quantity AS INT))", "l_partkey % 300 < 256 AND l_suppkey % 300 < 256"),
    ("ipv6", "lineitem", "l_orderkey", "concat(repeat(concat(lower(hex(l_partkey)), ':'), 5 + l_linenumber), '1')", "l_linenumber = 2 AND l_partkey < 65536"),
    ("uuid", "part", "p_partkey", "concat_ws('-', substr(md5(CAST(p_partkey AS STRING)), 1, 8), substr(md5(CAST(p_partkey AS STRING)), 9, 4), substr(md5(CAST(p_partkey AS STRING)), 13, 4), substr(md5(CAST(p_partkey AS STRING)), 17, 4), substr(md5(CAST(p_partkey AS STRING)), 21))", "substr(md5(p_partkey::VARCHAR), 13, 1) IN ('1', '2', '3', '4', '5', '6', '7', '8') AND substr(md5(p_partkey::VARCHAR), 17, 1) IN ('8', '9', 'a', 'b')"),
    ("email", "customer", "c_custkey", "concat(c_name, '@', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN '.com' ELSE '' END)", "c_custkey % 2 = 0"),
    ("uri-reference", "pages", "page_id", "CASE page_id % 4 WHEN 0 THEN substr(url, locate('://', url) + 1) WHEN 1 THEN concat('../', page_id, '?q#f') WHEN 2 THEN concat('a b/', page_id) ELSE concat('//bad host/', page_id) END", "page_id % 4 < 2"),
    ("iri-reference", "pages", "page_id", "CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('https:', page_id) ELSE 'http://' END", "page_id % 3 < 2"),
    ("uri-template", "pages", "page_id", "concat(url, CASE page_id % 4 WHEN 0 THEN '{?a,b{c}}' WHEN 1 THEN '{x' WHEN 2 THEN '}{' ELSE '' END)", "page_id % 4 IN (0, 3)"),
    ("idn-email", "customer", "c_custkey", "concat('ü', c_custkey, '@', CASE c_custkey % 4 WHEN 0 THEN 'bücher.example' WHEN 1 THEN 'a b.example' WHEN 2 THEN 'x@y.example' ELSE 'local' END)", "c_custkey % 4 IN (0, 3)"),
    ("idn-hostname", "pages", "page_id", "concat(CASE page_id % 3 WHEN 0 THEN 'é' WHEN 1 THEN '<' ELSE '' END, regexp_extract(url, '://([^/?#]*)', 1))", "page_id % 3 <> 1"),
    ("json-pointer", "part", "p_partkey", "concat('/', p_brand, CASE p_partkey % 3 WHEN 0 THEN '~1/x' WHEN 1 THEN '~' ELSE '' END)", "p_partkey % 3 <> 1"),
    ("duration", "part", "p_partkey", "concat('P', p_size, CASE WHEN p_partkey % 2 = 0 THEN 'D' ELSE '' END)", "p_partkey % 2 = 0"),
    ("regex", "part", "p_partkey", "concat(p_brand, CASE WHEN p_partkey % 2 = 1 THEN '(' ELSE '' END)", "p_partkey % 2 = 0"),
    ("byte", "part", "p_partkey", "substr(base64(encode(p_name, 'UTF-8')), 1, length(base64(encode(p_name, 'UTF-8'))) - p_partkey % 2)", "p_partkey % 2 = 0"),
    ("binary", "part", "p_partkey", "substr(hex(p_name), 1 + p_partkey % 2)", "p_partkey % 2 = 0"),
)


def _column_format(fmt: str, source: str, key: str, text: str, ok: str) -> None:
    name = "v_column_" + fmt.replace("-", "_")

    def query(spark, sf_dir):
        c = compiler({"$id": ID + name, "properties": {"text": {"type": "string", "format": fmt}}})
        df = balanced(table(spark, sf_dir, source)).select(key, F.expr(text).alias("text"))
        return V.summary(V.error_rows(df, c, ID + name, [key], V.row_value(df.select("text"))), key, "path", "keyword")

    C.add(name, query, f"SELECT {key}, '/text' AS path, 'format' AS keyword, count(*) AS n_errors FROM {source} WHERE NOT ({ok}) GROUP BY {key}")


for _args in COLUMN_FORMATS:
    _column_format(*_args)


def _numbers(name: str, fmt: str, expression: str, ok: str) -> None:
    def query(spark, sf_dir):
        c = compiler({"$id": ID + name, "properties": {"x": {"format": fmt}}})
        df = table(spark, sf_dir, "lineitem").select("l_linenumber", F.expr(expression).alias("x"))
        return df.where(~c.check(ID + name, V.row_value(df))).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))

    C.add(name, query, f"SELECT l_linenumber, count(*) AS n FROM (SELECT l_linenumber, {expression} AS x FROM lineitem) WHERE NOT ({ok}) GROUP BY 1")


_numbers("v_format_int32", "int32", "l_extendedprice * 100000", "x = floor(x) AND x >= -2147483648 AND x <= 2147483647")
_numbers("v_format_int64", "int64", "l_extendedprice * 1000000000000", "x = floor(x) AND abs(x) <= 9007199254740991")
_numbers("v_format_float", "float", "l_discount", "CAST(CAST(x AS FLOAT) AS DOUBLE) = x")


def _document(name: str, schema: dict, fails: str) -> None:
    """Events' documents that a schema rejects, counted by case."""

    def query(spark, sf_dir):
        c = compiler({"$id": ID + name} | schema)
        docs = event_docs(spark, sf_dir)
        return docs.where(~c.check(ID + name, Variant(F.col("doc")))).groupBy((F.col("event_id") % 6).alias("case_no")).agg(F.count(F.lit(1)).alias("n"))

    C.add(name, query, f"SELECT event_id % 6 AS case_no, count(*) AS n FROM (SELECT event_id, ({EVENT_DOC})::JSON AS d FROM events) WHERE {fails} GROUP BY 1")


K = "TRY_CAST(d->>'$.k' AS DOUBLE)"
for _args in (
    ("v_required", {"required": ["k"]}, "NOT list_contains(json_keys(d), 'k')"),
    ("v_property_type", {"properties": {"k": {"type": "integer"}}}, "list_contains(json_keys(d), 'k') AND json_type(d, '$.k') NOT IN ('UBIGINT', 'BIGINT')"),
    ("v_property_range", {"properties": {"k": {"minimum": 10, "maximum": 100}}}, f"json_type(d, '$.k') IN ('UBIGINT', 'BIGINT') AND NOT {K} BETWEEN 10 AND 100"),
    ("v_additional", {"properties": {"k": {}}, "additionalProperties": False}, "len(list_filter(json_keys(d), lambda x: x <> 'k')) > 0"),
    ("v_additional_schema", {"properties": {"k": {}}, "additionalProperties": {"type": "integer"}}, "json_type(d, '$.b') = 'ARRAY' OR json_type(d, '$.n_1') = 'VARCHAR'"),
    ("v_pattern_properties", {"patternProperties": {"^n_": {"type": "number"}}}, "json_type(d, '$.n_1') = 'VARCHAR'"),
    ("v_property_names", {"propertyNames": {"maxLength": 2}}, "len(list_filter(json_keys(d), lambda x: length(x) > 2)) > 0"),
    ("v_property_count", {"minProperties": 1, "maxProperties": 2}, "NOT len(json_keys(d)) BETWEEN 1 AND 2"),
    ("v_dependent_required", {"dependentRequired": {"a": ["b", "c"], "z": ["k"]}}, "list_contains(json_keys(d), 'a') AND NOT list_contains(json_keys(d), 'c')"),
    ("v_dependent_schemas", {"dependentSchemas": {"key": {"properties": {"k": {"type": "integer"}}}}}, "list_contains(json_keys(d), 'key') AND json_type(d, '$.k') = 'NULL'"),
    ("v_unevaluated_properties", {"allOf": [{"properties": {"k": {}}}], "anyOf": [{"required": ["z"], "properties": {"z": {}}}, {}], "unevaluatedProperties": False}, "len(list_filter(json_keys(d), lambda x: x NOT IN ('k', 'z'))) > 0"),
    ("v_prefix_items", {"properties": {"b": {"prefixItems": [{"const": 1}, {"const": 3}], "items": False}}}, "json_type(d, '$.b') = 'ARRAY'"),
    ("v_extra_forbid", {"ext:config": {"extra": "forbid"}, "properties": {"k": {}, "key": {}, "n_1": {}}}, "list_contains(json_keys(d), 'z') OR list_contains(json_keys(d), 'a')"),
    ("v_local_ref", {"$defs": {"small": {"type": "integer", "maximum": 50}}, "properties": {"k": {"$ref": "#/$defs/small"}}}, f"list_contains(json_keys(d), 'k') AND (json_type(d, '$.k') NOT IN ('UBIGINT', 'BIGINT') OR {K} > 50)"),
    ("v_boolean_schema", {"properties": {"z": False, "k": True}}, "list_contains(json_keys(d), 'z')"),
):
    _document(*_args)


@C.query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def v_content_json(spark, sf_dir):
    c = compiler({"$id": ID + "c", "properties": {"t": {"contentMediaType": "application/json"}}})
    df = table(spark, sf_dir, "events").select("event_id", F.expr("CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN concat(props, '}') ELSE substr(props, 2) END").alias("t"))
    return df.where(~c.check(ID + "c", V.row_value(df))).select("event_id")


@C.query("SELECT event_id FROM events WHERE event_id % 2 = 1")
def v_content_encoding(spark, sf_dir):
    c = compiler({"$id": ID + "c", "properties": {"t": {"contentEncoding": "base64"}}})
    df = table(spark, sf_dir, "events").select("event_id", F.expr("CASE event_id % 2 WHEN 0 THEN base64(encode(props, 'UTF-8')) ELSE '*?*' END").alias("t"))
    return df.where(~c.check(ID + "c", V.row_value(df))).select("event_id")


STATUS = {"type": "object", "properties": {"o_orderstatus": {"const": "F"}}}
RICH = {"properties": {"o_totalprice": {"minimum": 150000}}}
URGENT = {"properties": {"o_orderpriority": {"enum": ["1-URGENT", "2-HIGH"]}}}
_F, _R, _U = "o_orderstatus = 'F'", "o_totalprice >= 150000", "o_orderpriority IN ('1-URGENT', '2-HIGH')"


def _composed(name: str, schema: dict, valid: str) -> None:
    def query(spark, sf_dir):
        c = compiler({"$id": ID + name} | schema)
        df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
        return V.is_valid(df, c, ID + name).select("o_orderkey")

    C.add(name, query, f"SELECT o_orderkey FROM orders WHERE {valid}")


_composed("v_all_of", {"allOf": [STATUS, RICH]}, f"{_F} AND {_R}")
_composed("v_any_of", {"anyOf": [STATUS, RICH, URGENT]}, f"{_F} OR {_R} OR {_U}")
_composed("v_one_of", {"oneOf": [STATUS, RICH, URGENT]}, f"({_F})::INT + ({_R})::INT + ({_U})::INT = 1")
_composed("v_not", {"not": {"anyOf": [STATUS, RICH]}}, f"NOT ({_F} OR {_R})")
_composed("v_if_then_else", {"if": STATUS, "then": RICH, "else": URGENT}, f"CASE WHEN {_F} THEN {_R} ELSE {_U} END")


@C.query("SELECT o_orderkey, count(l.l_orderkey) = 0 AS empty FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1 HAVING count(l.l_orderkey) NOT BETWEEN 1 AND 6")
def v_order_lines(spark, sf_dir):
    """Nested documents: orders with their lines as an array of structs, of 1 to 6 lines."""
    c = compiler({"$id": ID + "o", "properties": {"lines": {"type": "array", "minItems": 1, "maxItems": 6, "items": {"properties": {"l_quantity": {"minimum": 1}}}}}})
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    docs = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    docs = docs.select("o_orderkey", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)).alias("lines"))
    return docs.where(~c.check(ID + "o", V.row_value(docs))).select("o_orderkey", (F.size("lines") == 0).alias("empty"))


@C.query("SELECT p_partkey FROM part WHERE p_partkey % 2 = 1")
def v_vocabulary(spark, sf_dir):
    """Formats of a document whose vocabulary turns them off aren't asserted; those of another one are."""
    off = {"$id": ID + "off", "$vocabulary": {FORMAT_VOCABULARY: False}, "properties": {"p_brand": {"format": "ipv4"}}}
    on = {"$id": ID + "on", "properties": {"p_brand": {"format": "ipv4"}}}
    c = compiler(off, on)
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    v = V.row_value(df)
    return df.where(F.when(F.col("p_partkey") % 2 == 1, c.check(off["$id"], v)).otherwise(c.check(on["$id"], v))).select("p_partkey")


@C.query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS n_plain, CASE WHEN c_acctbal < 5000 THEN 1 ELSE 0 END AS n_rich FROM customer")
def v_dynamic_ref(spark, sf_dir):
    """A generic list whose items are told by the document that uses it."""
    generic = {"$id": ID + "list", "type": "array", "items": {"$dynamicRef": "#item"}, "$defs": {"item": {"$dynamicAnchor": "item", "minimum": 0}}}
    plain = {"$id": ID + "plain", "properties": {"xs": {"$ref": ID + "list"}}}
    rich = {"$id": ID + "rich", "properties": {"xs": {"$ref": ID + "list"}}, "$defs": {"item": {"$dynamicAnchor": "item", "minimum": 5000}}}
    c = compiler(generic, plain, rich)
    df = table(spark, sf_dir, "customer").select("c_custkey", F.array("c_acctbal").alias("xs"))
    v = V.row_value(df)
    return df.select("c_custkey", F.size(c.errors(plain["$id"], v)).alias("n_plain"), F.size(c.errors(rich["$id"], v)).alias("n_rich"))


@C.query("SELECT l_orderkey, '/marks' AS path, 'uniqueItems' AS keyword FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey % 20) < count(*)")
def v_unique_items(spark, sf_dir):
    c = compiler({"$id": ID + "u", "type": "object", "properties": {"marks": {"type": "array", "uniqueItems": True}}})
    df = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") % 20).alias("marks"))
    return V.error_rows(df, c, ID + "u", ["l_orderkey"]).select("l_orderkey", "path", "keyword")


@C.query("SELECT p_partkey, CASE WHEN p_size > 20 THEN 'maximum' ELSE 'disjointWith' END AS keyword FROM part WHERE p_size >= 10")
def v_disjoint(spark, sf_dir):
    small = {"$id": ID + "small", "properties": {"p_size": {"maximum": 20}}, "disjointWith": ID + "large"}
    c = compiler(small, {"$id": ID + "large", "properties": {"p_size": {"minimum": 10}}})
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return V.error_rows(df, c, ID + "small", ["p_partkey"]).select("p_partkey", "keyword")


@C.query("SELECT c_custkey, 'invariant' AS keyword, 'a positive key is wanted' AS message FROM customer WHERE c_custkey <= 0")
def v_invariant(spark, sf_dir):
    c = compiler({"$id": ID + "c", "type": "object"})
    c.registry.add_invariant(ID + "c", "positive", lambda v: F.when(v.get("c_custkey").number() <= 0, "a positive key is wanted"))
    return V.error_rows(table(spark, sf_dir, "customer"), c, ID + "c", ["c_custkey"]).select("c_custkey", "keyword", "message")


@C.query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0")
def v_custom_keyword(spark, sf_dir):
    c = compiler({"$id": ID + "c", "properties": {"o_orderkey": {"divides": 7}}})
    c.registry.add_keyword("divides", lambda v, n: v.number() % n == 0, "number")
    df = table(spark, sf_dir, "orders")
    return df.where(~c.check(ID + "c", V.row_value(df))).select("o_orderkey")


ORDER = {
    "$id": ID + "order",
    "type": "object",
    "required": ["o_orderkey", "o_custkey"],
    "properties": {"o_orderstatus": {"enum": ["F", "O"]}, "o_totalprice": {"type": "number", "exclusiveMinimum": 1000, "maximum": 250000}, "o_orderpriority": {"type": "string", "pattern": "^[1-4]-", "maxLength": 8}},
}
_CASES = """
  SELECT o_orderkey, '/o_orderstatus' AS path, 'enum' AS keyword, 'must be one of the allowed values' AS message, 0 AS place FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
  UNION ALL SELECT o_orderkey, '/o_totalprice', 'maximum', 'must be <= 250000', 1 FROM orders WHERE o_totalprice > 250000
  UNION ALL SELECT o_orderkey, '/o_totalprice', 'exclusiveMinimum', 'must be > 1000', 2 FROM orders WHERE o_totalprice <= 1000
  UNION ALL SELECT o_orderkey, '/o_orderpriority', 'maxLength', 'must NOT have more than 8 characters', 3 FROM orders WHERE length(o_orderpriority) > 8
  UNION ALL SELECT o_orderkey, '/o_orderpriority', 'pattern', 'must match pattern "^[1-4]-"', 4 FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')
"""


@C.query(f"SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY place) - 1 AS INTEGER) AS ord, path, keyword, message FROM ({_CASES})")
def v_error_rows(spark, sf_dir):
    return V.error_rows(balanced(table(spark, sf_dir, "orders")), compiler(ORDER), ID + "order", ["o_orderkey"]).select("o_orderkey", "ord", "path", "keyword", "message")


@C.query(f"SELECT keyword, path, count(*) AS n_errors FROM ({_CASES}) GROUP BY 1, 2")
def v_error_summary(spark, sf_dir):
    return V.summary(V.error_rows(balanced(table(spark, sf_dir, "orders")), compiler(ORDER), ID + "order", ["o_orderkey"]))


@C.query(f"SELECT o_orderkey, count(*)::INTEGER AS n, array_to_string(list_sort(list_distinct(list(keyword))), ',') AS keywords, array_to_string(list_sort(list_distinct(list(substr(path, 2)))), ',') AS paths FROM ({_CASES}) GROUP BY 1")
def v_error_aggregate(spark, sf_dir):
    df = V.with_errors(table(spark, sf_dir, "orders"), compiler(ORDER), ID + "order").where(F.size("errors") > 0)
    a = V.aggregate(F.col("errors"))
    return df.select("o_orderkey", a["count"].alias("n"), F.array_join(a["keywords"], ",").alias("keywords"), F.array_join(a["paths"], ",").alias("paths"))


@C.query(f"SELECT o_orderkey, 422::BIGINT AS status, count(*) || ' validation error(s)' AS detail FROM ({_CASES}) GROUP BY 1")
def v_problem_report(spark, sf_dir):
    df = V.with_errors(table(spark, sf_dir, "orders"), compiler(ORDER), ID + "order")
    body = V.problem_report(F.col("errors"), F.concat(F.lit("/orders/"), F.col("o_orderkey").cast("string")))
    out = df.select("o_orderkey", body.alias("body")).where("body IS NOT NULL")
    return out.select("o_orderkey", F.get_json_object("body", "$.status").cast("bigint").alias("status"), F.get_json_object("body", "$.detail").alias("detail"))


@C.query(f"SELECT o_orderstatus, count(*) AS n_rows, count(*) FILTER (o_orderkey IN (SELECT o_orderkey FROM ({_CASES}))) AS n_bad FROM orders GROUP BY 1")
def v_quarantine(spark, sf_dir):
    good, bad = V.quarantine(table(spark, sf_dir, "orders"), compiler(ORDER), ID + "order")
    rows = good.select("o_orderstatus", F.lit(0).alias("bad")).unionByName(bad.select("o_orderstatus", F.lit(1).alias("bad")))
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("bad").alias("n_bad"))


NODE = {
    "$id": ID + "node", "type": "object", "required": ["n"], "patternProperties": {"^x": {"$ref": "#"}},
    "properties": {"n": {"type": "integer"}, "v": {"minimum": 5}, "kids": {"items": {"$ref": "#"}}, "first": {"$ref": "#"}, "other": {"not": {"$ref": "#"}}},
}
_ORDERS = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders"
_LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS j FROM lineitem"


def customer_trees(spark, sf_dir):
    """c_custkey, doc: customers with their orders, and orders with their lines, as nodes of one kind."""
    gathered = lambda n, v, *more: F.sort_array(F.collect_list(F.struct(F.col(n).alias("n"), F.col(v).alias("v"), *more)))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(gathered("l_linenumber", "l_quantity").alias("kids"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(gathered("o_orderkey", "o_totalprice", "kids", F.get("kids", 0).alias("first")).alias("kids"))
    node = F.struct(F.col("c_custkey").alias("n"), F.col("c_acctbal").alias("v"), "kids")
    return balanced(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")).join(orders, "c_custkey", "left").select("c_custkey", F.parse_json(F.to_json(node)).alias("doc"))


@C.query(f"""
WITH o AS ({_ORDERS}), l AS ({_LINES})
SELECT c_custkey, '/v' AS path, 'minimum' AS keyword FROM customer WHERE c_acctbal < 5
UNION ALL SELECT c_custkey, '/kids/' || i || '/v', 'minimum' FROM customer JOIN o ON o_custkey = c_custkey WHERE o_totalprice < 5
UNION ALL SELECT c_custkey, '/kids/' || i || '/kids/' || j || '/v', 'minimum' FROM customer JOIN o ON o_custkey = c_custkey JOIN l ON l_orderkey = o_orderkey WHERE l_quantity < 5
UNION ALL SELECT c_custkey, '/kids/' || i || '/first/v', 'minimum' FROM customer JOIN o ON o_custkey = c_custkey JOIN l ON l_orderkey = o_orderkey WHERE l_quantity < 5 AND j = 0
""")
def v_recursive_tree(spark, sf_dir):
    """A schema with five references to itself over nested documents."""
    return V.error_rows(customer_trees(spark, sf_dir), compiler(NODE), ID + "node", ["c_custkey"], Variant(F.col("doc"))).select("c_custkey", "path", "keyword")


@C.query("""
SELECT conv_id, count(*) FILTER (length(text) > 300) + count(*) FILTER (role = 'system') = 0 AS valid,
  coalesce(min(CASE WHEN length(text) > 300 THEN repeat('/next', turn) || '/n' WHEN role = 'system' THEN repeat('/next', turn) || '/role' END), '') AS first
FROM (SELECT conv_id, role, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INTEGER AS turn FROM conversations) GROUP BY conv_id
""")
def v_recursive_chain(spark, sf_dir):
    """Conversations as chains, each turn within the one before."""
    c = compiler({"$id": ID + "turn", "required": ["role"], "properties": {"role": {"enum": ["user", "assistant"]}, "n": {"maximum": 300}, "next": {"$ref": "#"}}})
    turn = F.struct("turn", "role", "text", F.to_json(F.struct("role", F.char_length("text").alias("n"))).alias("json"))
    turns = F.reverse(F.array_sort(F.collect_list(turn)))
    chain = F.aggregate(turns, F.lit(None).cast("string"), lambda inner, t: F.when(inner.isNull(), t["json"]).otherwise(F.concat(F.regexp_replace(t["json"], r"\}$", ""), F.lit(',"next":'), inner, F.lit("}"))))
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.parse_json(chain).alias("doc"))
    v = Variant(F.col("doc"))
    paths = F.transform(c.errors(ID + "turn", v), lambda e: e["path"])
    return docs.select("conv_id", c.check(ID + "turn", v).alias("valid"), F.coalesce(F.array_min(paths), F.lit("")).alias("first"))


QUERIES, SQL = C.queries, C.sql
