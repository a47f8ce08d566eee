"""Schema documents as quads, navigation of them as joins, and quads as documents again.

Each sub-schema is a node, named by its document and its pointer. Keywords that hold schemas are links to nodes, which say
under which key or at which place they stand; references are links to what they name; other keywords are literals with
their JSON. A catalogue is a table of documents, so that reading it is a narrow map (level by level within the row) and
every step of navigation is one join, however many schemas there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounds import rounds
from ..operators.quads import COLUMNS, XSD, quoted_json
from ..plans.registry import MANY, MAPPED, ONE

#: Namespace of keywords; and what a node says of its own place.
KEYWORD = "urn:schemaloom:keyword:"
KEY, INDEX, ROOT, REFERS = (f"urn:schemaloom:{x}" for x in ("key", "index", "root", "refersTo"))
JSON = "http://www.w3.org/1999/02/22-rdf-syntax-ns#JSON"
NODE = "struct<at:string,value:variant>"
QUAD = "struct<s:string,p:string,o:string,o_kind:string,o_datatype:string,ord:array<bigint>>"
DEPTH = 100


def _escaped(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def schema_quads(documents: DataFrame, id_col: str, body_col: str, depth: int = DEPTH) -> DataFrame:
    """Quads of schema documents (VARIANT). A node is ``id`` for a document and ``id#pointer`` below it.

    Sub-schemas are told from other values by their keyword: objects and booleans under keywords that hold one schema, the
    items or members of those that hold several. Documents nested deeper than ``depth`` raise an error.
    """
    rows = documents.select(F.col(id_col).cast("string").alias("_id"), F.col(body_col).alias("_body"))
    name = lambda at: F.when(at == "", F.col("_id")).otherwise(F.concat(F.col("_id"), F.lit("#"), at))
    as_map = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    as_array = lambda v: F.try_variant_get(v, "$", "array<variant>")
    is_schema = lambda v: as_map(v).isNotNull() | (F.schema_of_variant(v) == "BOOLEAN")
    none = F.array().cast(f"array<{NODE}>")

    def members(n: Column) -> Column:
        return F.map_entries(as_map(n["value"]))

    def below(n: Column) -> Column:
        """The sub-schemas of a node, as (keyword, key, index, node)."""

        def of(e: Column) -> Column:
            k, v = e["key"], e["value"]
            made = lambda at, x, key, i: F.struct(k.alias("keyword"), key.cast("string").alias("key"), i.cast("int").alias("index"), F.struct(at.alias("at"), x.alias("value")).alias("node"))
            here = F.concat(n["at"], F.lit("/"), k)
            one = F.array(made(here, v, F.lit(None), F.lit(None)))
            many = F.transform(as_array(v), lambda x, i: made(F.concat(here, F.lit("/"), i.cast("string")), x, F.lit(None), i))
            mapped = F.transform(F.map_entries(as_map(v)), lambda m: made(F.concat(here, F.lit("/"), _escaped(m["key"])), m["value"], m["key"], F.lit(None)))
            found = F.when(k.isin(*ONE) & is_schema(v), one).when(k.isin(*MANY), many).when(k.isin(*MAPPED), mapped)
            return F.filter(F.coalesce(found, F.array().cast(f"array<struct<keyword:string,key:string,index:int,node:{NODE}>>")), lambda m: is_schema(m["node"]["value"]))

        return F.coalesce(F.flatten(F.transform(members(n), of)), F.array().cast(f"array<struct<keyword:string,key:string,index:int,node:{NODE}>>"))

    def quad(s: Column, p: Column, o: Column, kind: str, datatype: str | None = None) -> Column:
        return F.struct(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype"), F.array().cast("array<bigint>").alias("ord"))

    def told(n: Column) -> Column:
        s = name(n["at"])
        links = F.flatten(F.transform(below(n), lambda m: F.array_compact(F.array(
            quad(s, F.concat(F.lit(KEYWORD), m["keyword"]), name(m["node"]["at"]), "iri"), F.when(m["key"].isNotNull(), quad(name(m["node"]["at"]), F.lit(KEY), m["key"], "literal", XSD + "string")),
            F.when(m["index"].isNotNull(), quad(name(m["node"]["at"]), F.lit(INDEX), m["index"].cast("string"), "literal", XSD + "integer")), quad(name(m["node"]["at"]), F.lit(ROOT), F.col("_id"), "iri"),
        ))))

        def plain(e: Column) -> Column:
            k, v = e["key"], e["value"]
            holds = (k.isin(*ONE) & is_schema(v)) | (k.isin(*MANY) & as_array(v).isNotNull() & (F.size(as_array(v)) > 0)) | (k.isin(*MAPPED) & as_map(v).isNotNull() & (F.size(F.map_keys(as_map(v))) > 0))
            text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
            target = F.when(text.startswith("#"), F.concat(F.col("_id"), F.when(text == "#", "").otherwise(text))).otherwise(F.regexp_replace(text, "#$", ""))
            own = quad(s, F.concat(F.lit(KEYWORD), k), F.to_json(v), "literal", JSON)
            return F.when(holds, F.array().cast(f"array<{QUAD}>")).otherwise(F.array_compact(F.array(own, F.when(k.isin("$ref", "$dynamicRef") & text.isNotNull(), quad(s, F.lit(REFERS), target, "iri")))))

        boolean = F.array(quad(s, F.lit(KEYWORD + "boolean"), F.to_json(n["value"]), "literal", JSON))
        return F.when(F.schema_of_variant(n["value"]) == "BOOLEAN", boolean).otherwise(F.concat(links, F.coalesce(F.flatten(F.transform(members(n), plain)), F.array().cast(f"array<{QUAD}>"))))

    start = F.struct(F.array(F.struct(F.lit("").alias("at"), F.col("_body").alias("value"))).alias("now"), F.array(quad(F.col("_id"), F.lit(ROOT), F.col("_id"), "iri")).alias("done"))

    def step(state: Column) -> Column:
        following = F.flatten(F.transform(state["now"], lambda n: F.transform(below(n), lambda m: m["node"])))
        return F.struct(F.coalesce(following, none).alias("now"), F.concat(state["done"], F.flatten(F.transform(state["now"], told))).alias("done"))

    end = rows.where(F.col("_body").isNotNull()).select("_id", rounds(start, lambda state: F.size(state["now"]) > 0, step, depth).alias("end"))
    deep = F.when(F.size("end.now") > 0, F.raise_error(F.lit(f"schemas are nested deeper than {depth}")).cast(f"array<{QUAD}>")).otherwise(F.col("end.done"))
    q = end.select(F.posexplode(deep).alias("i", "q")).select("q.*", "i").withColumn("ord", F.array(F.col("i").cast("bigint"))).drop("i")
    null = F.lit(None).cast("string")
    return q.withColumns({"s_kind": F.lit("iri"), "o_lang": null, "g": null, "qs": null, "qp": null, "qo": null}).select(*COLUMNS, "ord")


# navigation: each a join or two over the quads


def children(q: DataFrame) -> DataFrame:
    """parent, keyword, key, index, child: where each sub-schema stands."""
    links = q.where(F.col("p").startswith(KEYWORD) & (F.col("o_kind") == "iri")).select(F.col("s").alias("parent"), F.expr(f"substr(p, {len(KEYWORD) + 1})").alias("keyword"), F.col("o").alias("child"))
    place = q.where(F.col("p").isin(KEY, INDEX)).groupBy(F.col("s").alias("child")).agg(F.max(F.when(F.col("p") == KEY, F.col("o"))).alias("key"), F.max(F.when(F.col("p") == INDEX, F.col("o"))).cast("int").alias("index"))
    return links.join(place, "child", "left").select("parent", "keyword", "key", "index", "child")


def keywords(q: DataFrame) -> DataFrame:
    """node, keyword, value (JSON text): what sub-schemas say by themselves."""
    return q.where(F.col("p").startswith(KEYWORD) & (F.col("o_kind") == "literal")).select(F.col("s").alias("node"), F.expr(f"substr(p, {len(KEYWORD) + 1})").alias("keyword"), F.col("o").alias("value"))


def domains(q: DataFrame) -> DataFrame:
    """property, class, node: the schemas that declare a property, and its own schema there."""
    root = q.where(F.col("p") == ROOT).select(F.col("s").alias("parent"), F.col("o").alias("class"))
    return children(q).where("keyword = 'properties'").join(root, "parent").select(F.col("key").alias("property"), "class", F.col("child").alias("node"))


def ranges(q: DataFrame) -> DataFrame:
    """property, class, range: what a property, or the items of one that is a list, refers to."""
    refers = q.where(F.col("p") == REFERS).select(F.col("s").alias("node"), F.col("o").alias("range"))
    of = domains(q)
    items = children(q).where("keyword = 'items'").select(F.col("parent").alias("node"), F.col("child").alias("item"))
    own = of.join(refers, "node").select("property", "class", "range")
    return own.unionByName(of.join(items, "node").drop("node").withColumnRenamed("item", "node").join(refers, "node").select("property", "class", "range"))


def listed(q: DataFrame, keyword: str) -> DataFrame:
    """node, idx, item: the members of a keyword's list of texts (required, enum), in order."""
    own = keywords(q).where(F.col("keyword") == keyword)
    return own.select("node", F.posexplode(F.from_json("value", "array<string>")).alias("idx", "item"))


def to_schema(q: DataFrame) -> DataFrame:
    """schema_id, body: documents out of their quads, as JSON text with sorted keys.

    Sub-schemas are folded into what holds them from the innermost outwards, a round for each level of the deepest document.
    """
    from ..operators.selection import pinned

    links = pinned(children(q))
    # a value of a node: keyword, and for members of lists and maps their place, with the JSON
    values = keywords(q).select(F.col("node").alias("parent"), "keyword", F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("index"), "value")
    every = q.where(F.col("p") == ROOT).select(F.col("s").alias("node"), F.col("o").alias("schema_id"))
    left, waiting = pinned(every.where("node <> schema_id").select("node")), links
    while True:
        now = pinned(left.join(waiting.select(F.col("parent").alias("node")).distinct(), "node", "left_anti"))
        if now.isEmpty():
            break
        made = folded(values.join(now.withColumnRenamed("node", "parent"), "parent", "left_semi"), now)
        held = waiting.join(made.select(F.col("node").alias("child"), F.col("body").alias("value")), "child").select("parent", "keyword", "key", "index", "value")
        values = pinned(values.join(now.withColumnRenamed("node", "parent"), "parent", "left_anti").unionByName(held))
        waiting, left = pinned(waiting.join(now.withColumnRenamed("node", "child"), "child", "left_anti")), pinned(left.join(now, "node", "left_anti"))
    roots = every.where("node = schema_id").select("node")
    return folded(values, roots).select(F.col("node").alias("schema_id"), "body")


def folded(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, body of the nodes, from their values; one without any is the empty schema."""
    one = F.max(F.when(F.col("key").isNull() & F.col("index").isNull(), F.col("value")))
    listed_ = F.array_sort(F.collect_list(F.when(F.col("index").isNotNull(), F.struct("index", "value"))))
    mapped = F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value"))))
    by = values.groupBy(F.col("parent").alias("node"), "keyword").agg(one.alias("one"), listed_.alias("many"), mapped.alias("mapped"))
    many = F.concat(F.lit("["), F.array_join(F.transform("many", lambda x: x["value"]), ","), F.lit("]"))
    members = F.concat(F.lit("{"), F.array_join(F.transform("mapped", lambda x: F.concat(quoted_json(x["key"]), F.lit(":"), x["value"])), ","), F.lit("}"))
    by = by.select("node", "keyword", F.when(F.size("many") > 0, many).when(F.size("mapped") > 0, members).otherwise(F.col("one")).alias("value"))
    member = F.transform(F.array_sort(F.collect_list(F.struct("keyword", "value"))), lambda x: F.concat(quoted_json(x["keyword"]), F.lit(":"), x["value"]))
    body = by.groupBy("node").agg(F.max(F.when(F.col("keyword") == "boolean", F.col("value"))).alias("boolean"), F.concat(F.lit("{"), F.array_join(member, ","), F.lit("}")).alias("body"))
    return nodes.join(body, "node", "left").select("node", F.coalesce("boolean", "body", F.lit("{}")).alias("body"))
