"""Documents as quads, and quads as documents.

A schema compiles to one expression per row, an array of small structs, which is exploded: a single narrow pass, however
many properties there are. What is constant of a quad (predicate, kinds, datatype, graph) is in a table of templates on
the driver, and a struct only has the template's number, the subject and the object. Subjects of nested objects are
paths under their owner's subject.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import decimal_text, number_text
from ..functions.texts import in_hexadecimal
from ..plans.compiler import _At
from ..plans.project import Projector
from ..plans.registry import Registry, ext
from ..plans.values import WHOLE, Typed, Value

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
TYPE = RDF + "type"
#: A quad before its template's constants are filled in. dt and kind are null but where the value decides them.
MADE = "struct<t:int,s:string,o:string,dt:string,qs:string,qo:string>"
COLUMNS = ("s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang", "g", "qs", "qp", "qo")
SCHEMA = "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string, g string, qs string, qp string, qo string, ord array<bigint>"

# The datatypes of JSON types and of formats.
TYPE_DATATYPES = {"boolean": "boolean", "integer": "integer", "number": "decimal", "string": "string"}
FORMAT_DATATYPES = {
    "date": "date", "date-time": "dateTime", "duration": "duration", "time": "time", "byte": "base64Binary", "binary": "hexBinary",
    "uri": "anyURI", "iri": "anyURI", "uri-reference": "anyURI", "iri-reference": "anyURI", "uri-template": "anyURI",
    "double": "double", "float": "float", "int32": "int", "int64": "long",
}
# Datatypes that decode to integers and to other numbers.
INTEGER_TYPES = ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")
DECIMAL_TYPES = ("decimal", "double", "float")
#: How often an emitter follows schemas that it has met before on the way; documents that go deeper raise an error.
REPEATS = 9
#: Place within a document after which items that come as rows of their own follow.
ITEMS = 1 << 40


def _number(order: Column | None) -> Column:
    return F.coalesce(order.cast("bigint"), F.lit(0).cast("bigint")) if order is not None else F.lit(0).cast("bigint")


def number_literal(v: Value) -> Column:
    """A number as text: whole numbers and decimals in full, doubles as JavaScript prints them; not finite ones are an error."""
    if isinstance(v, Typed):
        if isinstance(v.kind, WHOLE):
            return v.col.cast("string")
        if isinstance(v.kind, T.DecimalType):
            return decimal_text(v.col)
        return number_text(_finite(v.number()))
    long = F.when(v.schema == "BIGINT", F.try_variant_get(v.col, "$", "bigint").cast("string"))
    return F.coalesce(long, number_text(_finite(v.number())))


def _finite(n: Column) -> Column:
    return F.when(F.isnan(n) | (F.abs(n) == float("inf")), F.raise_error(F.lit("a number isn't finite")).cast("double")).otherwise(n)


class Emitter:
    """Compiles schemas to quads.

    ``predicate_for(class id, property)`` may name predicates; else an absolute predicate keyword or $id does, else class#property.
    """

    def __init__(self, registry: Registry, predicate_for: Callable[[str, str], str | None] | None = None, graph: str | None = None, annotations: str = "star-only", only: set[str] | None = None):
        """``only``: the predicates that are wanted; others are pruned from the plan, nested objects that lead to none of them too."""
        self.registry, self.predicate_for, self.graph, self.annotations, self.only = registry, predicate_for, graph, annotations, only
        self.shapes = Projector(registry)

    def predicate(self, class_id: str, name: str, schema) -> str:
        if isinstance(schema, dict):
            if explicit := ext(schema, "predicate"):
                return explicit
            if isinstance(schema.get("$id"), str) and "://" in schema["$id"][1:]:
                return schema["$id"]
        made = self.predicate_for(class_id, name) if self.predicate_for else None
        return made or f"{class_id}#{name}"

    def quads(self, df: DataFrame, schema_id: str, subject: Column, value: Value, order: Column | None = None) -> DataFrame:
        """The quads of each row. ord is an array: the document's place where ``order`` gives one (a number), then the quad's within
        it; without it, documents are told apart by their IRIs."""
        place = [_number(order)]
        key = self.registry.expand(schema_id)
        self.templates: dict[tuple, int] = {}
        return self._exploded(df, place, self._object(self.registry[key], key, _At(key), subject, value, (id(self.registry[key]),)))

    def item_quads(self, df: DataFrame, schema_id: str, name: str, owner: Column, index: Column, value: Value, order: Column | None = None) -> DataFrame:
        """The quads of the items of an array property that come as rows of their own: each is linked to its owner, as if it
        had been gathered into the owner's document at ``index`` before, after the document's own quads."""
        key = self.registry.expand(schema_id)
        sub, own = self.shapes.properties(self.registry[key], _At(key))[name]
        target, at = self.shapes._deref(sub, own)
        self.templates = {}
        place = [_number(order), F.lit(ITEMS).cast("bigint"), index.cast("bigint")]
        nested = F.concat(owner, F.lit(f"/{name}/"), index.cast("string"))
        return self._exploded(df, place, self._one(self.predicate(own.root, name, sub), target.get("items", {}), at, owner, value, nested, (id(self.registry[key]),)))

    def _exploded(self, df: DataFrame, place: list[Column], quads: Column) -> DataFrame:
        rows = list(self.templates)
        if not rows:
            return df.sparkSession.createDataFrame([], SCHEMA)
        made = df.select(F.array(*place).alias("_place"), F.posexplode(quads).alias("_pos", "q")).where(F.col("q.o").isNotNull())

        def of(i: int) -> Column:
            """A constant of the template; where all have the same it is one for the optimizer too, which then can leave filters out."""
            values = [r[i] for r in rows]
            if len(set(values)) == 1:
                return F.lit(values[0]).cast("string")
            return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), F.col("q.t") + 1)

        quoted = any(r[5] for r in rows)
        s_kind = (F.when(F.col("q.qs").isNotNull(), "triple") if quoted else F).when(F.col("q.s").startswith("_:"), "bnode").otherwise("iri")
        return made.select(
            F.col("q.s").alias("s"), s_kind.alias("s_kind"), of(0).alias("p"), F.col("q.o").alias("o"), of(1).alias("o_kind"), F.coalesce(of(2), F.col("q.dt")).alias("o_datatype"), of(3).alias("o_lang"),
            of(4).alias("g"), F.col("q.qs").alias("qs"), of(5).alias("qp"), F.col("q.qo").alias("qo"), F.array(*(F.col("_place")[i] for i in range(len(place))), F.col("_pos").cast("bigint")).alias("ord"),
        )

    def _quad(self, s: Column, p: str, o: Column, o_kind: str, datatype: str | Column | None = None, lang: str | None = None, quoted: tuple[Column, str, Column] | None = None) -> Column:
        """An array of one quad. ``quoted`` is the statement (subject, predicate, object) that the quad is about."""
        dynamic = isinstance(datatype, Column)
        t = self.templates.setdefault((p, o_kind, None if dynamic else datatype, lang, self.graph, quoted[1] if quoted else None), len(self.templates))
        text = lambda x: (x if x is not None else F.lit(None)).cast("string")
        if quoted:
            s = F.concat(F.lit("<<"), quoted[0], F.lit(f" {quoted[1]} "), quoted[2], F.lit(">>"))
        return F.array(F.struct(F.lit(t).alias("t"), text(s).alias("s"), text(o).alias("o"), text(datatype if dynamic else None).alias("dt"), text(quoted and quoted[0]).alias("qs"), text(quoted and quoted[2]).alias("qo")))

    def _object(self, schema, class_id: str, at, subject: Column, v: Value, path: tuple[int, ...], quoted=None) -> Column:
        """``path``: the schemas on the way, as deep as they go; only those met again are bounded."""
        parts = [self._quad(subject, TYPE, F.lit(class_id), "iri", quoted=quoted)] if self.wants(TYPE) else []
        for name, (sub, own) in self.shapes.properties(schema, at).items():
            if not self._leads(name, sub, own, set()):
                continue
            # a property's predicate belongs to the class that declares it
            parts.append(self._property(name, sub, own, own.root, subject, v.get(name), path, quoted))
        return F.concat(*parts) if parts else F.array().cast(f"array<{MADE}>")

    def wants(self, predicate: str) -> bool:
        return self.only is None or predicate in self.only

    def _leads(self, name: str, schema, at, seen: set[int]) -> bool:
        """Whether a property makes a wanted quad, itself or below it."""
        if self.only is None or self.wants(self.predicate(at.root, name, schema)):
            return True
        target, own = self.shapes._deref(schema, at)
        if ext(target, "annotatedEdge"):
            return True
        if self.shapes.kind(target, own) == "array":
            target, own = self.shapes._deref(target.get("items", {}), own)
        if self.shapes.kind(target, own) != "object" or id(target) in seen:
            return False
        seen.add(id(target))
        return self.wants(TYPE) or any(self._leads(n, s, o, seen) for n, (s, o) in self.shapes.properties(target, own).items())

    def _property(self, name, sub, at, class_id, subject, v: Value, path, quoted=None) -> Column:
        none = F.array().cast(f"array<{MADE}>")
        p = self.predicate(class_id, name, sub)
        target, own = self.shapes._deref(sub, at)
        if edge := ext(target, "annotatedEdge") or ext(sub, "annotatedEdge"):
            return F.when(v.present() & ~v.is_type("null"), self._edge(edge, own, subject, v)).otherwise(none)
        kind = self.shapes.kind(target, own)
        if kind == "array":
            items = target.get("items") if isinstance(target.get("items"), dict) else {}
            if isinstance(v, Typed) and not isinstance(v.kind, T.ArrayType):
                return none
            each = lambda x, i: self._one(p, items, own, subject, v.item(x), F.concat(subject, F.lit(f"/{name}/"), i.cast("string")), path, quoted)
            return F.when(v.is_type("array"), F.coalesce(F.flatten(F.transform(v.items(), each)), none)).otherwise(none)
        return self._one(p, sub, at, subject, v, F.concat(subject, F.lit(f"/{name}")), path, quoted)

    def _one(self, p, schema, at, subject, v: Value, nested: Column, path, quoted=None) -> Column:
        none = F.array().cast(f"array<{MADE}>")
        target, own = self.shapes._deref(schema, at)
        class_id = own.root if target is not schema else f"{at.root}"
        kind = self.shapes.kind(target, own)
        here = v.present() & ~v.is_type("null")
        if kind == "object":
            if not self.shapes.properties(target, own):
                return none
            path = (*path, id(target))
            if len(path) - len(set(path)) > REPEATS:
                deeper = F.raise_error(F.lit(f"objects of {class_id} are nested deeper than {REPEATS} times")).cast(f"array<{MADE}>")
                return F.when(here, deeper).otherwise(none)
            inner = self._object(target, class_id, own, nested, v, path, quoted)
            return F.when(here, F.concat(inner, self._quad(subject, p, nested, "iri", quoted=quoted)) if self.wants(p) else inner).otherwise(none)
        said = target if isinstance(target, dict) else {}
        made = lambda o, o_kind="literal", datatype=None, lang=None: F.when(here, self._quad(subject, p, o, o_kind, datatype, lang, quoted)).otherwise(none)
        if ext(said, "iriRef"):
            o = v.text()
            absolute = o.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
            return made(F.when(o.isNull() | absolute, o).otherwise(F.raise_error(F.concat(F.lit("not an absolute IRI: "), o)).cast("string")), "iri")
        if lang := ext(said, "language"):
            return made(v.text(), datatype=RDF + "langString", lang=lang)
        fmt = FORMAT_DATATYPES.get(said.get("format", ""))
        if kind in ("number", "integer"):
            return made(number_literal(v), datatype=XSD + (fmt or TYPE_DATATYPES[kind]))
        flag = F.when(v.is_type("boolean"), v.col.cast("string") if isinstance(v, Typed) else F.try_variant_get(v.col, "$", "string"))
        if kind == "boolean":
            return made(flag, datatype=XSD + "boolean")
        if kind == "string":
            return made(v.text(), datatype=XSD + (fmt or "string"))
        n = v.number()  # no declared type: the value's own
        datatype = F.when(n.isNull(), F.when(v.is_type("boolean"), XSD + "boolean").otherwise(XSD + "string")).when(n == F.floor(n), XSD + "integer").otherwise(XSD + "double")
        return made(F.coalesce(F.when(n.isNotNull(), number_literal(v)), flag, v.text()), datatype=datatype)

    def _edge(self, edge: dict, at, subject: Column, v: Value) -> Column:
        if self.graph is None:
            raise ValueError(f"the annotated edge {edge['predicate']} needs a graph")
        p, o = edge["predicate"], v.get("target").text()
        parts = [self._quad(subject, p, o, "iri")]
        for name, sub in edge["annotations"].items():
            a = v.get("annotations").get(name)
            ap = self.predicate(at.root, name, sub)
            nested = F.concat(subject, F.lit(f"/{name}"))
            if self.annotations in ("star-only", "both"):
                parts.append(self._one(ap, sub, at, subject, a, nested, (), (subject, p, o)))
            if self.annotations in ("flat-only", "both"):
                parts.append(self._one(ap, sub, at, subject, a, nested, ()))
        return F.concat(*parts)


def document_quads(df: DataFrame, emitter: Emitter, compiler, schema_id: str, column: str, subject: Column | None = None, on_invalid: str = "raise", order: Column | None = None) -> DataFrame:
    """The quads of documents that satisfy their schema, with its defaults and computed fields filled in.

    A document that doesn't is an error, or has no quads where ``on_invalid`` is "drop". Without a subject, documents
    are named by a hash of their content.
    """
    from .validation import instantiate, row_value

    made = instantiate(df, compiler, schema_id, column, policy="failfast" if on_invalid == "raise" else "quarantine").where(F.col("instance").isNotNull())
    value = row_value(made, "instance")
    return emitter.quads(made, schema_id, hashed("urn:hash:", value.canonical()) if subject is None else subject, value, order)


def same_as_quads(spark, registry: Registry) -> DataFrame:
    """Symmetric sameAs quads of the registry's identity axioms."""
    rows = [(a, "iri", OWL + "sameAs", b, "iri", None, None, None, None, None, None, [i]) for i, (x, y) in enumerate(sorted(registry.same)) for a, b in ((x, y), (y, x))]
    return spark.createDataFrame(rows, SCHEMA)


def decoded(q: DataFrame) -> DataFrame:
    """quads with ``number`` and ``flag`` columns: what their literals decode to."""
    name = F.substring_index("o_datatype", "#", -1)
    number = F.when(name.isin(*INTEGER_TYPES), F.regexp_extract("o", r"^\s*([+-]?\d+)", 1).try_cast("double")).when(name.isin(*DECIMAL_TYPES), F.col("o").try_cast("double"))
    return q.withColumns({"number": number, "flag": F.when(name == "boolean", F.col("o").isin("true", "1"))})


def deduplicated(q: DataFrame) -> DataFrame:
    """One quad for each (s, p, o, g), datatype and language aside: the first in order. A map-side aggregate."""
    rest = [c for c in q.columns if c not in ("s", "p", "o", "g", "ord")]
    first = q.groupBy("s", "p", "o", "g").agg(F.min_by(F.struct(*rest), "ord").alias("_rest"), F.min("ord").alias("ord"))
    return first.select("s", "p", "o", "g", "_rest.*", "ord").select(*q.columns)


def lift(q: DataFrame, registry: Registry, schema_id: str, emitter: Emitter | None = None, depth: int = 3, structural: bool = False, defaults: bool = False, repeats: bool = False, source: Callable[[set[str]], DataFrame] | None = None) -> DataFrame:
    """s, instance: the typed documents of a class, gathered from its quads; nested objects are joined bottom-up.

    Nesting is followed as deep as the schema goes. Schemas that are met again within themselves are followed ``depth``
    times; an instance with objects below that raises an error.

    A subject is of the class if its first type is. The quads of one subject are gathered with a conditional aggregate
    (partial sums map-side), so a class needs one shuffle by subject and one join per level of nesting.

    ``structural``: subjects of classes with all of the class's properties are of it too, with the predicates of their own
    class; a property without a quad of its predicate is taken from predicates that end in # and its name. Then all predicates
    have to be looked at, where else only those of the class are read. ``defaults``: declared defaults are filled in.

    Quads are a set: one that is said twice is one item of a list. ``repeats``: only where it is said twice at the same place
    (ord), so that a list with equal items, as the emitter writes it, comes back whole.

    ``source`` gives the quads of some predicates where that is cheaper than to filter all, as for a ``Graph``: the class and
    each class nested in it only make what they read.
    """
    emitter = emitter or Emitter(registry)
    key = registry.expand(schema_id)
    out = _lift(q, emitter, registry[key], key, _At(key), depth, (id(registry[key]),), structural, repeats, source)
    if defaults:
        filled = Projector(registry, coerce=True, defaults=True).project(key, Typed(F.col("instance"), out.schema["instance"].dataType))
        out = out.select("s", filled.alias("instance"))
    return out


def compatible(emitter: Emitter, names: set[str], class_id: str) -> dict[str, dict[str, str]]:
    """The predicates of properties, by class, of the registered classes that have all of some properties; the class itself comes first."""
    out: dict[str, dict[str, str]] = {}
    for key in dict.fromkeys([class_id, *emitter.registry]):
        props = emitter.shapes.properties(emitter.registry[key], _At(key)) if emitter.registry.has(key) else {}
        if names <= set(props):
            out[key] = {n: emitter.predicate(props[n][1].root, n, props[n][0]) for n in names}
    return out


def _said(x: Column, repeats: bool) -> Column:
    """What makes a quad of a subject and predicate the same as another."""
    return F.struct(x["o"], F.coalesce(x["g"], F.lit("")), *([x["ord"]] if repeats else []))


def _first_of_each(members: Column, repeats: bool) -> Column:
    """The members (ord, o, g, v) in order, without those that were said before: a quad said twice is one."""
    ordered = F.array_sort(members)
    key = lambda x: _said(x, repeats)
    keys = F.transform(ordered, key)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), ordered).otherwise(F.filter(ordered, lambda x, i: F.array_position(keys, key(x)) == i + 1))


def _typed(q: DataFrame, class_id: str) -> DataFrame:
    return q.where(F.col("p") == TYPE).groupBy("s").agg(F.min_by("o", "ord").alias("_class")).where(F.col("_class") == class_id).select("s")


def _lift(q: DataFrame, emitter: Emitter, schema, class_id: str, at, depth: int, path: tuple[int, ...], structural: bool = False, repeats: bool = False, source: Callable[[set[str]], DataFrame] | None = None) -> DataFrame:
    of = lambda *wanted: (q if source is None else source(set(wanted))).where(F.col("p").isin(*wanted))
    props = emitter.shapes.properties(schema, at)
    if structural and not props:
        return q.sparkSession.createDataFrame([], "s string, instance struct<>")
    others = compatible(emitter, set(props), class_id) if structural else {}
    plain, nested, ended = [], [], []
    for name, (sub, own) in props.items():
        p = emitter.predicate(own.root, name, sub)
        target, inner = emitter.shapes._deref(sub, own)
        many = emitter.shapes.kind(target, inner) == "array"
        items = target.get("items", {}) if many else sub
        leaf, leaf_at = emitter.shapes._deref(items, inner if many else own)
        kind = emitter.shapes.kind(leaf, leaf_at)
        if kind == "object":
            leaf_class, way = leaf_at.root if leaf is not items else class_id, (*path, id(leaf))
            if len(way) - len(set(way)) > depth:
                ended.append((name, p, leaf_class))
            else:
                nested.append((name, p, many, leaf, leaf_class, leaf_at, way))
            continue
        plain.append((name, p, many, kind))
    o = F.col("o")
    value = {"number": o.try_cast("double"), "integer": F.coalesce(o.try_cast("bigint"), o.try_cast("double").cast("bigint")), "boolean": o.isin("true", "1")}
    # all of a class in one aggregate by subject: its type, single values as the first in order, others gathered
    made = [F.min_by(F.when(F.col("p") == TYPE, o), F.when(F.col("p") == TYPE, F.col("ord"))).alias("_class")]
    suffix = F.when(F.col("p").contains("#"), F.substring_index("p", "#", -1))

    def gathered(mine: Column, v: Column, many: bool) -> Column:
        if many:
            return F.transform(_first_of_each(F.collect_list(F.when(mine, F.struct("ord", "o", "g", v.alias("v")))), repeats), lambda x: x["v"])
        return F.min_by(F.when(mine, F.struct(v.alias("v"))), F.when(mine, F.struct("ord", "o")))["v"]

    chosen: dict[str, Column] = {}
    for i, (name, p, many, kind) in enumerate(plain):
        v = value.get(kind, o)
        if not structural:
            made.append(gathered(F.col("p") == p, v, many).alias(name))
            continue
        by = {x: f"_{i}_{j}" for j, x in enumerate(dict.fromkeys([p, *(c[name] for c in others.values())]))}
        made += [gathered(F.col("p") == x, v, many).alias(n) for x, n in by.items()] + [gathered(suffix == name, v, many).alias(f"_{i}")]
        own = F.lit(None)
        for c, predicates in others.items():
            own = F.when(F.col("_class") == c, F.col(by[predicates[name]])).otherwise(own)
        chosen[name] = F.when(F.size(own) > 0, own).otherwise(F.col(f"_{i}")) if many else F.coalesce(own, F.col(f"_{i}"))
    if structural:
        out = q.where((F.col("p") == TYPE) | suffix.isin([n for n, *_ in plain]) | F.col("p").isin([c[n] for c in others.values() for n, *_ in plain])).groupBy("s").agg(*made)
        out = out.where(F.col("_class").isin(list(others))).select("s", "_class", *(c.alias(n) for n, c in chosen.items()))
    else:
        out = of(TYPE, *(p for _, p, _, _ in plain)).groupBy("s").agg(*made).where(F.col("_class") == class_id).drop("_class")
    for name, p, many, leaf, leaf_class, leaf_at, way in nested:
        inner = _lift(q, emitter, leaf, leaf_class, leaf_at, depth, way, structural, repeats, source).select(F.col("s").alias("o"), F.col("instance"))
        links = of(p).select("s", "o", "g", "ord").join(inner, "o")
        if structural:
            links = _links_of(q, name, others, out).join(inner, "o")
        if many:
            compare = lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
            ordered = F.array_sort(F.collect_list(F.struct("ord", "o", "g", "instance")), compare)
            keys = F.transform(ordered, lambda x: _said(x, repeats))
            got = F.filter(ordered, lambda x, i: F.array_position(keys, _said(x, repeats)) == i + 1)
            got = F.transform(F.when(F.size(F.array_distinct(keys)) == F.size(keys), ordered).otherwise(got), lambda x: x["instance"])
        else:
            got = F.min_by(F.struct("instance"), F.struct("ord", "o"))["instance"]
        out = out.join(links.groupBy("s").agg(got.alias(name)), "s", "left")
    instance = F.struct(*(F.col(n) for n in props if n in out.columns))
    for name, p, leaf_class in ended:
        deeper = of(p).join(_typed(of(TYPE), leaf_class).select(F.col("s").alias("o")), "o", "left_semi")
        out = out.join(deeper.select("s", F.lit(True).alias(f"_below {name}")).distinct(), "s", "left")
        said = F.concat(F.lit(f"{name} is nested deeper than lift(depth={depth}) follows, at "), F.col("s"))
        instance = F.when(F.col(f"`_below {name}`").isNotNull(), F.raise_error(said)).otherwise(instance)
    return out.select("s", instance.alias("instance"))


def _links_of(q: DataFrame, name: str, classes: dict[str, dict[str, str]], subjects: DataFrame) -> DataFrame:
    """s, o, g, ord of a property's links: those of the predicate of the subject's own class, or where it has none those whose predicate ends in its name."""
    wanted = F.lit(None).cast("string")
    for c, predicates in classes.items():
        wanted = F.when(F.col("_class") == c, F.lit(predicates[name])).otherwise(wanted)
    named = q.where(F.col("p").isin([c[name] for c in classes.values()]) | (F.col("p").contains("#") & (F.substring_index("p", "#", -1) == name)))
    links = named.select("s", "p", "o", "g", "ord").join(subjects.select("s", wanted.alias("_wanted")), "s")
    own = F.col("p") == F.col("_wanted")
    some = links.where(own).select("s").distinct()
    return links.where(own).unionByName(links.where(~own & F.substring_index("p", "#", -1).eqNullSafe(name)).join(some, "s", "left_anti")).select("s", "o", "g", "ord")


# reading and writing


def read_nquads(spark, path: str, on_error: str = "raise") -> DataFrame:
    """N-Quads lines as quads; empty lines and comments are skipped. ord rises with the lines of a file; files follow each other as Spark deals them."""
    return parse_nquads(spark.read.text(path).select("value", F.array(F.monotonically_increasing_id()).alias("ord")), on_error)


_IRI, _BNODE, _LITERAL = r"<[^<>]*>", r"_:[^\s<>\"]+", r'"(?:[^"\\]|\\.)*"(?:\^\^<[^<>]*>|@[A-Za-z0-9-]+)?'
_QUOTED = rf"<<\s*(?:{_IRI}|{_BNODE})\s*{_IRI}\s*(?:{_IRI}|{_BNODE})\s*>>"
_LINE = rf"^\s*({_IRI}|{_BNODE}|{_QUOTED})\s*({_IRI})\s*({_IRI}|{_BNODE}|{_LITERAL})\s*({_IRI}|{_BNODE})?\s*\.\s*(?:#.*)?$"
_NOTHING = r"^\s*(?:#.*)?$"


def bad_nquads(lines: DataFrame) -> DataFrame:
    """The lines that are neither a quad nor empty nor a comment."""
    return lines.where(~F.col("value").rlike(_LINE) & ~F.col("value").rlike(_NOTHING))


def unescaped(text: Column) -> Column:
    """The escapes of N-Quads undone from left to right: those of JSON, an escaped apostrophe, and code points of eight digits.

    Two backslashes in a row always are an escaped one, as an escape starts with the first of a run; so what lies between
    such pairs is looked at by itself.
    """
    def point(part: Column) -> Column:
        char = F.decode(F.unhex(F.substring(part, 1, 8)), "UTF-32")
        return F.concat(F.when(char.isin('"', "\\"), F.concat(F.lit("\\"), char)).otherwise(char), F.substring(part, 9, 1 << 30))

    def wide(piece: Column) -> Column:
        parts = F.split(F.regexp_replace(piece, r"\\'", "'"), r"\\U(?=[0-9A-Fa-f]{8})")
        return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), point), ""))

    pieces = F.split(text, r"\\\\")
    body = F.when(text.rlike(r"\\[U']"), F.array_join(F.transform(pieces, wide), "\\\\")).otherwise(text)
    json = F.from_json(F.concat(F.lit('["'), in_hexadecimal(body, r"[\x00-\x1f]"), F.lit('"]')), "array<string>")
    told = F.coalesce(json[0], F.raise_error(F.concat(F.lit("bad escape: "), text)).cast("string"))
    return F.when(text.contains("\\"), told).otherwise(text)


def parse_nquads(lines: DataFrame, on_error: str = "raise") -> DataFrame:
    """Quads of lines (value, ord). A line that is no quad is an error, or left out where ``on_error`` is "drop"; ``bad_nquads`` gives such lines."""
    value = F.col("value")
    if on_error == "raise":
        value = F.when(value.rlike(_LINE) | value.rlike(_NOTHING), value).otherwise(F.raise_error(F.concat(F.lit("not a quad: "), value)).cast("string"))
        lines = lines.withColumn("value", value)
    part = lambda i: F.regexp_extract("value", _LINE, i)
    rows = lines.where(F.col("value").rlike(_LINE)).select("ord", *(part(i).alias(n) for i, n in enumerate(("s", "p", "o", "g"), 1)))
    bare = lambda c: F.when(c.startswith("<"), unescaped(F.substring(c, 2, F.length(c) - 2))).otherwise(c)
    inner = rf"^<<\s*({_IRI}|{_BNODE})\s*({_IRI})\s*({_IRI}|{_BNODE})\s*>>$"
    star = F.col("s").startswith("<<")
    qs, qp, qo = (F.when(star, bare(F.regexp_extract("s", inner, i))) for i in (1, 2, 3))
    body = unescaped(F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1))
    is_literal = F.col("o").startswith('"')
    lang, datatype = F.regexp_extract("o", r'"@([A-Za-z0-9-]+)$', 1), F.regexp_extract("o", r'"\^\^<([^<>]*)>$', 1)
    kind = lambda c: F.when(F.col(c).startswith("_:"), "bnode").otherwise("iri")
    return rows.select(
        F.when(star, F.concat(F.lit("<<"), qs, F.lit(" "), qp, F.lit(" "), qo, F.lit(">>"))).otherwise(bare(F.col("s"))).alias("s"), F.when(star, "triple").otherwise(kind("s")).alias("s_kind"),
        bare(F.col("p")).alias("p"), F.when(is_literal, body).otherwise(bare(F.col("o"))).alias("o"), F.when(is_literal, "literal").otherwise(kind("o")).alias("o_kind"),
        F.when(is_literal, F.when(lang != "", RDF + "langString").when(datatype != "", datatype).otherwise(XSD + "string")).alias("o_datatype"),
        F.when(is_literal & (lang != ""), lang).alias("o_lang"), F.when(F.col("g") != "", bare(F.col("g"))).alias("g"), qs.alias("qs"), qp.alias("qp"), qo.alias("qo"), "ord",
    )


def to_nquads(q: DataFrame) -> DataFrame:
    """One text line per quad."""
    safe = lambda c: in_hexadecimal(c, r'[<>"{}|^`\\\x00-\x20]')
    term = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), safe(c), F.lit(">")))
    body = F.col("o")
    for char, escape in (("\\\\", "\\\\\\\\"), ('"', '\\\\"'), ("\n", "\\\\n"), ("\r", "\\\\r"), ("\t", "\\\\t")):
        body = F.regexp_replace(body, char, escape)
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_datatype") == XSD + "string", "").otherwise(F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">")))
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), body, F.lit('"'), F.coalesce(tail, F.lit("")))).otherwise(term(F.col("o")))
    s = F.when(F.col("s_kind") == "triple", F.concat(F.lit("<< "), term(F.col("qs")), F.lit(" "), term(F.col("qp")), F.lit(" "), term(F.col("qo")), F.lit(" >>"))).otherwise(term(F.col("s")))
    g = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), term(F.col("g")))).otherwise("")
    return q.select(F.concat(s, F.lit(" "), term(F.col("p")), F.lit(" "), o, g, F.lit(" .")).alias("value"))


def quoted_json(c: Column) -> Column:
    """Text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def to_jsonld(q: DataFrame) -> DataFrame:
    """s, node: one JSON-LD node per subject, predicates in order, each with its values. Grouped by subject, which is bounded by a document's size.
    ``jsonld.to_jsonld_documents`` nests them."""
    v = F.when(F.col("o_kind") != "literal", F.to_json(F.struct(F.col("o").alias("@id")))).otherwise(
        F.to_json(F.struct(F.col("o").alias("@value"), F.when(F.col("o_lang").isNull(), F.col("o_datatype")).alias("@type"), F.col("o_lang").alias("@language")))
    )
    v = F.when(F.col("p") == TYPE, quoted_json(F.col("o"))).otherwise(v)
    key = F.when(F.col("p") == TYPE, "@type").otherwise(F.col("p"))
    by = q.groupBy("s", key.alias("k")).agg(F.array_sort(F.collect_list(F.struct("ord", v.alias("v")))).alias("vs"), F.min("ord").alias("ord"))
    values = F.array_join(F.transform("vs", lambda x: x["v"]), ",")
    by = by.select("s", "ord", F.concat(quoted_json(F.col("k")), F.lit(":["), values, F.lit("]")).alias("member"))
    node = by.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("ord", "member"))).alias("m"))
    return node.select("s", F.concat(F.lit('{"@id":'), quoted_json(F.col("s")), F.lit(","), F.array_join(F.transform("m", lambda x: x["member"]), ","), F.lit("}")).alias("node"))


def lists(q: DataFrame, cells: bool = False) -> DataFrame:
    """head, idx, item (or, where ``cells`` are asked for, cell): the members of RDF lists. Each cell finds its head by doubling the reach of its link backwards, so a
    list of n cells takes log2(n) rounds; cells that have found theirs take no part in later ones. Cells of a cycle have no head and are left out."""
    from .selection import stored

    is_rest = F.col("p") == RDF + "rest"
    said = stored(q.where(is_rest | (F.col("p") == RDF + "first")).select("s", "o", is_rest.alias("is_rest")))
    links, nil = said.where("is_rest").select("s", "o"), RDF + "nil"
    every = links.select(F.col("s").alias("cell")).repartition("cell").distinct()
    # every list ends in nil, which is no cell, so one task would get all last cells
    inner = links.where(F.col("o") != nil) if links.where(F.col("s") == nil).isEmpty() else links
    back = inner.select(F.col("o").alias("cell"), F.col("s").alias("up")).repartition("cell").distinct()
    at = stored(every.join(back, "cell", "left").select("cell", F.coalesce("up", "cell").alias("up"), F.col("up").isNotNull().cast("bigint").alias("idx"), F.col("up").isNull().alias("done")))
    found, going = at.where("done"), at.where("NOT done")
    while True:
        far = found.unionByName(going).select(F.col("cell").alias("up"), F.col("up").alias("further"), F.col("idx").alias("more"), F.col("done"))
        at = stored(going.drop("done").join(far, "up").select("cell", F.col("further").alias("up"), (F.col("idx") + F.col("more")).alias("idx"), "done"))
        ready, left = at.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        found, going = found.unionByName(at.where("done")), at.where("NOT done")
        if not ready or not left:
            break
    out = found.select("cell", F.col("up").alias("head"), F.col("idx").cast("int").alias("idx"))
    first = said.where("NOT is_rest").select(F.col("s").alias("cell"), F.col("o").alias("item"))
    return out if cells else out.join(first, "cell").select("head", "idx", "item")


# other libraries' terms

#: Kinds of terms by the names that RDF libraries share.
TERM_KINDS = {"iri": "NamedNode", "bnode": "BlankNode", "literal": "Literal", "triple": "Quad"}


def from_terms(df: DataFrame, subject: str = "subject", predicate: str = "predicate", object_: str = "object", graph: str | None = "graph", order: str | None = None) -> DataFrame:
    """Quads of rows of terms: structs of termType and value, with datatype (a term or text) and language for literals, and
    subject, predicate and object of a quoted triple as its value's members.

    Variables, and rows without one of the three terms, are an error, as they are no data.
    """
    names = F.create_map(*(F.lit(x) for k, v in TERM_KINDS.items() for x in (v, k)))
    kinds = {f.name: f.dataType for f in df.schema}
    blank = lambda t: F.when(t["termType"] == "BlankNode", F.concat(F.lit("_:"), F.regexp_replace(t["value"], "^_:", ""))).otherwise(t["value"])
    s, p, o = (F.col(c) for c in (subject, predicate, object_))
    quoted = isinstance(kinds[subject], T.StructType) and {"subject", "predicate", "object"} <= set(kinds[subject].names)
    inner = [blank(s[x]) for x in ("subject", "predicate", "object")] if quoted else [F.lit(None).cast("string")] * 3
    is_quoted = s["termType"] == "Quad"
    datatype = F.lit(None).cast("string")
    if "datatype" in kinds[object_].names:
        datatype = o["datatype"]["value"] if isinstance(kinds[object_]["datatype"].dataType, T.StructType) else o["datatype"]
    lang = F.nullif(o["language"], F.lit("")) if "language" in kinds[object_].names else F.lit(None).cast("string")
    literal = o["termType"] == "Literal"
    fine = F.coalesce(F.map_contains_key(names, s["termType"]) & (p["termType"] == "NamedNode") & F.map_contains_key(names, o["termType"]) & p["value"].isNotNull() & o["value"].isNotNull(), F.lit(False))
    kind_of = lambda t: F.try_element_at(names, t["termType"])
    checked = F.when(fine, kind_of(s)).otherwise(F.raise_error(F.concat(F.lit("not a quad of terms: "), F.to_json(F.struct(s, p, o)))).cast("string"))
    g = F.when(F.col(graph)["termType"] != "DefaultGraph", blank(F.col(graph))) if graph and graph in df.columns else F.lit(None).cast("string")
    at = F.array(F.col(order).cast("bigint")) if order else F.array(F.monotonically_increasing_id())
    said = F.when(is_quoted, F.concat(F.lit("<<"), inner[0], F.lit(" "), inner[1], F.lit(" "), inner[2], F.lit(">>"))).otherwise(blank(s))
    return df.select(
        said.alias("s"), checked.alias("s_kind"), p["value"].alias("p"), blank(o).alias("o"), kind_of(o).alias("o_kind"),
        F.when(literal, F.when(lang.isNotNull(), RDF + "langString").otherwise(F.coalesce(datatype, F.lit(XSD + "string")))).alias("o_datatype"), F.when(literal, lang).alias("o_lang"), g.alias("g"),
        *(F.when(is_quoted, x).alias(n) for x, n in zip(inner, ("qs", "qp", "qo"), strict=True)), at.alias("ord"),
    )


def to_terms(q: DataFrame) -> DataFrame:
    """Rows of terms (subject, predicate, object, graph) of quads, as ``from_terms`` reads them."""
    names = F.create_map(*(F.lit(x) for kv in TERM_KINDS.items() for x in kv))
    bare = lambda c: F.regexp_replace(c, "^_:", "")
    plain = lambda c: F.struct(F.when(c.startswith("_:"), "BlankNode").otherwise("NamedNode").alias("termType"), bare(c).alias("value"))
    quoted = F.col("s_kind") == "triple"
    s = F.struct(names[F.col("s_kind")].alias("termType"), F.when(quoted, "").otherwise(bare(F.col("s"))).alias("value"), *(F.when(quoted, plain(F.col(c))).alias(n) for c, n in (("qs", "subject"), ("qp", "predicate"), ("qo", "object"))))
    value = F.when(F.col("o_kind") == "bnode", bare(F.col("o"))).otherwise(F.col("o"))
    datatype = F.when(F.col("o_kind") == "literal", F.struct(F.lit("NamedNode").alias("termType"), F.col("o_datatype").alias("value")))
    o = F.struct(names[F.col("o_kind")].alias("termType"), value.alias("value"), datatype.alias("datatype"), F.when(F.col("o_kind") == "literal", F.coalesce("o_lang", F.lit(""))).alias("language"))
    g = F.when(F.col("g").isNull(), F.struct(F.lit("DefaultGraph").alias("termType"), F.lit("").alias("value"))).otherwise(plain(F.col("g")))
    return q.select(s.alias("subject"), F.struct(F.lit("NamedNode").alias("termType"), F.col("p").alias("value")).alias("predicate"), o.alias("object"), g.alias("graph"), "ord")


# subjects


def well_known_genid(base: str, seed: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/.well-known/genid/"), seed)


def from_property(base: str, value: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(value.cast("string")))


def hashed(base: str, *values: Column) -> Column:
    """A content-hash subject; 64 bits, so that a corpus has room for it."""
    return F.concat(F.lit(base), F.lower(F.hex(F.xxhash64(*values))))


def random_subject(base: str) -> Column:
    """A subject of its own for each row; another one each time it is asked for, so its rows should be stored."""
    return F.concat(F.lit(base), F.uuid())


def first_subject(*made: Column) -> Column:
    """The first of several ways to name a subject that gives one."""
    return F.coalesce(*made)


def is_genid(c: Column) -> Column:
    return c.contains("/.well-known/genid/")


def compact_iri(c: Column, prefixes: dict[str, str]) -> Column:
    """IRIs as CURIEs under the longest namespace that they start with."""
    out = None
    for name, base in sorted(prefixes.items(), key=lambda x: (-len(x[1]), x[0])):
        short = F.concat(F.lit(name + ":"), F.substring(c, len(base) + 1, 1 << 30))
        out = F.when(c.startswith(base), short) if out is None else out.when(c.startswith(base), short)
    return c if out is None else out.otherwise(c)


def expanded_iri(c: Column, prefixes: dict[str, str]) -> Column:
    """CURIEs as IRIs; what has no known prefix, or // after its colon, stays."""
    out = None
    for name, base in sorted(prefixes.items()):
        mine = c.startswith(name + ":") & ~c.startswith(name + "://")
        full = F.concat(F.lit(base), F.substring(c, len(name) + 2, 1 << 30))
        out = F.when(mine, full) if out is None else out.when(mine, full)
    return c if out is None else out.otherwise(c)


def issued(q: DataFrame, prefix: str = "_:c") -> DataFrame:
    """Blank nodes under issued names: numbered from 0 in order of their labels, the same in subjects and objects."""
    from .selection import Graph, Selection

    blank = q.where(F.col("s_kind") == "bnode").select(F.col("s").alias("iri")).unionByName(q.where(F.col("o_kind") == "bnode").select(F.col("o").alias("iri"))).distinct()
    names = Selection(Graph(q), blank.select(F.lit(0).cast("bigint").alias("ord"), "iri")).numbered()
    names = names.select("iri", F.concat(F.lit(prefix), (F.col("place") - 1).cast("string")).alias("name"))
    for c, kind in (("s", "s_kind"), ("o", "o_kind")):
        known = names.select(F.col("iri").alias("_was"), F.col("name").alias("_is"))
        q = q.join(known, (F.col(kind) == "bnode") & (F.col(c) == F.col("_was")), "left").withColumn(c, F.coalesce("_is", c)).drop("_was", "_is")
    return q


def lift_one(q: DataFrame, registry: Registry, schema_id: str, iri: str, emitter: Emitter | None = None, depth: int = 3, repeats: bool = False) -> DataFrame:
    """s, instance of one subject: only its own quads and those of what it leads to, whatever that is named, are gathered.

    The links are walked a step at a time from the subject, and each step only joins what the last one found.
    """
    from .selection import pinned

    emitter = emitter or Emitter(registry)
    key = registry.expand(schema_id)
    found = q.sparkSession.createDataFrame([(iri,)], "s string")
    steps = _links(emitter, registry[key], _At(key), depth, (id(registry[key]),))
    front = found
    while steps:
        links = q.where(F.col("p").isin(sorted({p for p, _ in steps})) & (F.col("o_kind") != "literal")).select("s", "o")
        front = pinned(links.join(front, "s", "left_semi").select(F.col("o").alias("s")).distinct())
        if front.isEmpty():
            break
        found = found.unionByName(front)
        steps = [x for _, more in steps for x in more]
    return lift(q.join(found.distinct(), "s", "left_semi"), registry, schema_id, emitter, depth, repeats=repeats).where(F.col("s") == iri)


def _links(emitter: Emitter, schema, at, depth: int, path: tuple[int, ...]) -> list[tuple[str, list]]:
    """(predicate, links below it) of the properties that hold objects, as deep as ``lift`` follows them and one step more."""
    out = []
    for name, (sub, own) in emitter.shapes.properties(schema, at).items():
        target, inner = emitter.shapes._deref(sub, own)
        many = emitter.shapes.kind(target, inner) == "array"
        leaf, leaf_at = emitter.shapes._deref(target.get("items", {}) if many else sub, inner if many else own)
        if emitter.shapes.kind(leaf, leaf_at) == "object":
            way = (*path, id(leaf))
            below = [] if len(way) - len(set(way)) > depth else _links(emitter, leaf, leaf_at, depth, way)
            out.append((emitter.predicate(own.root, name, sub), below))
    return out


def deskolemized(q: DataFrame) -> DataFrame:
    """Well-known genid IRIs as blank nodes."""
    genid = r"/\.well-known/genid/"
    blank = lambda c: F.when(F.col(c).rlike(genid), F.concat(F.lit("_:"), F.regexp_extract(c, genid + r"(.*)$", 1))).otherwise(F.col(c))
    is_iri = F.col("o_kind") != "literal"
    s, o = blank("s"), F.when(is_iri, blank("o")).otherwise(F.col("o"))
    return q.withColumns({"s_kind": F.when(s.startswith("_:"), "bnode").otherwise(F.col("s_kind")), "o_kind": F.when(is_iri & o.startswith("_:"), "bnode").otherwise(F.col("o_kind")), "s": s, "o": o})
