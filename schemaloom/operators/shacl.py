"""SHACL validation of a quads table.

Shapes are parsed on the driver into a small plan. All that a node's own quads tell (counts of values, of values that fail
a test, of types) comes from one aggregate by subject, and shapes are Boolean algebra over its columns; what values have to
conform to takes one more aggregate for each level of nesting, joined to the values of all paths at once. So the number of
passes over the quads depends on how deep shapes are nested, not on how many there are. A named shape's target is the class
of its IRI (direct types only).

Shapes that lead back to themselves are evaluated as sets of failing nodes instead; a shape met again on its own path
conforms, so that ends.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import is_regex
from ..plans.compiler import regex
from .quads import RDF, SH, TYPE, XSD, decoded

REPORT = "focus_node string, result_path string, value string, source_shape string, component string, message string, severity string"
FIELDS = [f.split()[0] for f in REPORT.split(", ")]
#: Constraints of a value by itself: parameter -> (component, is violated).
BOUNDS = {
    "minInclusive": ("MinInclusive", lambda n, b: n < b), "maxInclusive": ("MaxInclusive", lambda n, b: n > b),
    "minExclusive": ("MinExclusive", lambda n, b: n <= b), "maxExclusive": ("MaxExclusive", lambda n, b: n >= b),
}


@dataclass
class Shape:
    """A node shape or a property shape; ``path`` is None for a node shape."""

    iri: str
    path: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    properties: list[Shape] = field(default_factory=list)


def parse_shapes(rows: list[tuple[str, str, str, str]]) -> dict[str, Shape]:
    """Shapes by IRI from (s, p, o, o_kind) rows of a shapes graph, which is schema-sized."""
    by: dict[str, list[tuple[str, str, str]]] = {}
    for s, p, o, kind in rows:
        by.setdefault(s, []).append((p, o, kind))

    def members(head: str) -> list[str]:
        out, seen = [], set()
        while head != RDF + "nil" and head not in seen:
            seen.add(head)
            cell = dict((p, o) for p, o, _ in by.get(head, []))
            if RDF + "first" in cell:
                out.append(cell[RDF + "first"])
            head = cell.get(RDF + "rest", RDF + "nil")
        return out

    shapes: dict[str, Shape] = {}

    def build(iri: str) -> Shape:
        if iri in shapes:
            return shapes[iri]
        shape = shapes[iri] = Shape(iri)
        for p, o, _ in by.get(iri, []):
            if not p.startswith(SH):
                continue
            name = p[len(SH) :]
            if name == "path":
                shape.path = o
            elif name == "property":
                shape.properties.append(build(o))
            elif name in ("and", "or", "xone"):
                shape.params.setdefault(name, []).append([build(x) for x in members(o)])
            elif name in ("in", "ignoredProperties"):
                shape.params[name] = members(o)
            elif name in ("not", "node"):
                shape.params.setdefault(name, []).append(build(o))
            elif name == "qualifiedValueShape":
                shape.params[name] = build(o)
            elif name in ("class", "hasValue"):
                shape.params.setdefault(name, []).append(o)
            else:
                shape.params[name] = o
        return shape

    for s, po in by.items():
        if any(p == TYPE and o in (SH + "NodeShape", SH + "PropertyShape") for p, o, _ in po):
            build(s)
    return shapes


class Validator:
    def __init__(self, shapes: dict[str, Shape], quads: DataFrame):
        self.shapes = shapes
        self.q = decoded(quads)
        self._failed: dict[tuple, tuple[DataFrame, DataFrame]] = {}
        self.types = self.q.where(F.col("p") == TYPE).select(F.col("s").alias("node"), F.col("o").alias("class")).distinct()

    def report(self) -> DataFrame:
        """One row per violation; the data conform if there is none."""
        targets = [s for s in self.shapes.values() if s.path is None and not s.iri.startswith("_:")]
        if not any(_cyclic(s, ()) for s in targets):
            return Table(self).report(targets)
        parts = []
        for shape in targets:
            focus = self.types.where(F.col("class") == shape.iri).select(F.col("node").alias("focus"))
            parts += self.violations(shape, focus, frozenset())
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return self.q.sparkSession.createDataFrame([], REPORT) if out is None else out

    def conforms(self) -> bool:
        return self.report().isEmpty()

    # helpers

    def _row(self, rows: DataFrame, shape: Shape, component: str, message: str, value: Column | None = None) -> DataFrame:
        return rows.select(
            F.col("focus").alias("focus_node"), F.lit(shape.path).cast("string").alias("result_path"), (value if value is not None else F.lit(None)).cast("string").alias("value"),
            F.lit(shape.iri).alias("source_shape"), F.lit(SH + component + "ConstraintComponent").alias("component"), F.lit(message).alias("message"), F.lit("Violation").alias("severity"),
        )

    def _matching(self, o: Column, pattern: str) -> Column:
        """Whether a value matches; nothing matches a pattern that isn't one."""
        return o.rlike(regex(pattern)) if is_regex(pattern) else F.lit(False)

    def tests(self, p: dict[str, Any]) -> list[tuple[str, Column, str]]:
        """(component, is violated, message) of the constraints of a value by itself. Components and messages, here and below."""
        o = F.col("o")
        units = F.octet_length(F.encode(o, "UTF-16BE")) / 2
        tests: list[tuple[str, Column, str]] = []
        if "datatype" in p:
            tests.append(("Datatype", (F.col("o_kind") == "literal") & (F.coalesce("o_datatype", F.lit(XSD + "string")) != p["datatype"]), f"must have datatype {p['datatype']}"))
        if "nodeKind" in p:
            kinds = {"IRI": ["iri"], "Literal": ["literal"], "BlankNode": ["bnode"], "BlankNodeOrIRI": ["bnode", "iri"], "BlankNodeOrLiteral": ["bnode", "literal"], "IRIOrLiteral": ["iri", "literal"]}[p["nodeKind"].removeprefix(SH)]
            tests.append(("NodeKind", ~F.col("o_kind").isin(kinds), f"must be of kind {p['nodeKind']}"))
        if "pattern" in p:
            tests.append(("Pattern", ~self._matching(o, p["pattern"]), f'must match pattern "{p["pattern"]}"'))
        if "minLength" in p:
            tests.append(("MinLength", units < int(p["minLength"]), f"must have at least {p['minLength']} characters"))
        if "maxLength" in p:
            tests.append(("MaxLength", units > int(p["maxLength"]), f"must have at most {p['maxLength']} characters"))
        for name, (component, fails) in BOUNDS.items():
            if name in p:
                n = o.try_cast("double")
                tests.append((component, n.isNull() | F.isnan(n) | fails(n, F.lit(float(p[name]))), f"must satisfy {name} {p[name]}"))
        if p.get("in"):
            tests.append(("In", ~o.isin(p["in"]), "must be one of the allowed values"))
        return tests

    def _values(self, focus: DataFrame, path: str) -> DataFrame:
        """focus, o, o_kind, o_datatype, number of each value at a path."""
        mine = self.q.where(F.col("p") == path).select("s", "o", "o_kind", "o_datatype", "number")
        return focus.join(mine, F.col("focus") == F.col("s")).drop("s")

    def failing(self, shape: Shape, nodes: DataFrame, seen: frozenset) -> DataFrame:
        """node: those that violate a shape. A shape on its own path conforms."""
        if shape.iri in seen or shape.params.get("deactivated") == "true":
            return nodes.select("node").limit(0)
        key = (shape.iri, id(nodes), seen)
        if key not in self._failed:  # the nodes are kept beside, so that no others get their identity
            out = None
            for p in self.violations(shape, nodes.select(F.col("node").alias("focus")), seen):
                p = p.select(F.col("focus_node").alias("node"))
                out = p if out is None else out.unionByName(p)
            self._failed[key] = nodes, nodes.select("node").limit(0) if out is None else out.distinct()
        return self._failed[key][1]

    def violations(self, shape: Shape, focus: DataFrame, seen: frozenset) -> list[DataFrame]:
        if shape.params.get("deactivated") == "true" or shape.iri in seen:
            return []
        seen = seen | {shape.iri}
        focus = focus.distinct()
        if shape.path is not None:
            return self._property(shape, focus, seen)
        out = []
        for p in shape.properties:
            out += self.violations(p, focus, seen)
        out += self._logic(shape, focus, "focus", seen)
        if shape.params.get("closed") == "true":
            allowed = [TYPE, *shape.params.get("ignoredProperties", []), *(p.path for p in shape.properties if p.path)]
            extra = focus.join(self.q.where(~F.col("p").isin(allowed)).select("s", "p", "o"), F.col("focus") == F.col("s"))
            told = self._row(extra.select("focus", "p").distinct(), shape, "Closed", "predicate is not allowed, as the shape is closed", F.col("p"))
            out.append(told.withColumns({"result_path": F.col("value"), "value": F.lit(None).cast("string")}))
        if "in" in shape.params and shape.params["in"]:
            out.append(self._row(focus.where(~F.col("focus").isin(shape.params["in"])), shape, "In", "must be one of the allowed values", F.col("focus")))
        for v in shape.params.get("hasValue", []):
            out.append(self._row(focus.where(F.col("focus") != v), shape, "HasValue", f"must have value {v}"))
        return out

    def _property(self, shape: Shape, focus: DataFrame, seen: frozenset) -> list[DataFrame]:
        p, out = shape.params, []
        values = self._values(focus, shape.path)
        if {"minCount", "maxCount"} & p.keys():
            mine = self.q.where(F.col("p") == shape.path).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
            counted = focus.join(mine, F.col("focus") == F.col("s"), "left").select("focus", F.coalesce("n", F.lit(0)).alias("n"))
            if "minCount" in p:
                out.append(self._row(counted.where(F.col("n") < int(p["minCount"])), shape, "MinCount", f"must have at least {p['minCount']} value(s)"))
            if "maxCount" in p:
                out.append(self._row(counted.where(F.col("n") > int(p["maxCount"])), shape, "MaxCount", f"must have at most {p['maxCount']} value(s)"))
        o, tests = F.col("o"), self.tests(p)
        if tests:  # all of them in one pass over the values
            said = F.array_compact(F.array(*(F.when(fails, F.struct(F.lit(SH + component + "ConstraintComponent").alias("component"), F.lit(message).alias("message"))) for component, fails, message in tests)))
            bad = values.select("focus", "o", F.inline(said))
            out.append(bad.select(
                F.col("focus").alias("focus_node"), F.lit(shape.path).cast("string").alias("result_path"), o.cast("string").alias("value"), F.lit(shape.iri).alias("source_shape"), "component", "message", F.lit("Violation").alias("severity"),
            ))
        for v in p.get("hasValue", []):
            having = values.where(o == v).select("focus")
            out.append(self._row(focus.join(having, "focus", "left_anti"), shape, "HasValue", f"must have value {v}"))
        out += self._logic(shape, values, "o", seen)
        if "qualifiedValueShape" in p:
            out += self._qualified(shape, focus, values, seen)
        return out

    def _logic(self, shape: Shape, rows: DataFrame, at: str, seen: frozenset) -> list[DataFrame]:
        """class, node, and, or, xone and not of focus nodes or values."""
        p, out = shape.params, []
        nodes = rows.select(F.col(at).alias("node")).distinct()
        value = F.col(at)

        def told(bad: DataFrame, component: str, message: str) -> None:
            out.append(self._row(rows.join(bad.select(F.col("node").alias(at)).distinct(), at, "left_semi"), shape, component, message, value))

        for c in p.get("class", []):
            mine = self.types.where(F.col("class") == c).select("node")
            told(nodes.join(mine, "node", "left_anti"), "Class", f"must be an instance of {c}")
        for s in p.get("node", []):
            told(self.failing(s, nodes, seen), "Node", f"must conform to {s.iri}")
        for group in p.get("and", []):
            for s in group:
                told(self.failing(s, nodes, seen), "And", f"must conform to {s.iri}")
        for group in p.get("or", []):
            bad = nodes
            for s in group:
                bad = bad.join(self.failing(s, nodes, seen), "node", "left_semi")
            told(bad, "Or", "must conform to at least one shape")
        for group in p.get("xone", []):
            bad = None
            for s in group:
                f = self.failing(s, nodes, seen)
                bad = f if bad is None else bad.unionByName(f)
            failed = bad.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
            told(nodes.join(failed, "node", "left").where(F.coalesce("n", F.lit(0)) != len(group) - 1), "Xone", "must conform to exactly one shape")
        for s in p.get("not", []):
            if s.iri not in seen:
                told(nodes.join(self.failing(s, nodes, seen), "node", "left_anti"), "Not", f"must not conform to {s.iri}")
        return out

    def _qualified(self, shape: Shape, focus: DataFrame, values: DataFrame, seen: frozenset) -> list[DataFrame]:
        p, inner, out = shape.params, shape.params["qualifiedValueShape"], []
        nodes = values.select(F.col("o").alias("node")).distinct()
        if set(inner.params) == {"datatype"} and not inner.properties and inner.path is None:
            good = values.where(F.col("o_datatype") == inner.params["datatype"])
        else:
            good = values.join(self.failing(inner, nodes, seen).select(F.col("node").alias("o")), "o", "left_anti")
        n = good.groupBy("focus").agg(F.count(F.lit(1)).alias("n"))
        counted = focus.join(n, "focus", "left").select("focus", F.coalesce("n", F.lit(0)).alias("n"))
        if "qualifiedMinCount" in p:
            out.append(self._row(counted.where(F.col("n") < int(p["qualifiedMinCount"])), shape, "QualifiedMinCount", f"must have at least {p['qualifiedMinCount']} conforming value(s)"))
        if "qualifiedMaxCount" in p:
            out.append(self._row(counted.where(F.col("n") > int(p["qualifiedMaxCount"])), shape, "QualifiedMaxCount", f"must have at most {p['qualifiedMaxCount']} conforming value(s)"))
        return out


def _inner(shape: Shape) -> list[Shape]:
    p = shape.params
    groups = [s for k in ("and", "or", "xone") for g in p.get(k, []) for s in g]
    return [*shape.properties, *p.get("node", []), *p.get("not", []), *groups, *([p["qualifiedValueShape"]] if "qualifiedValueShape" in p else [])]


def _cyclic(shape: Shape, way: tuple[str, ...]) -> bool:
    return shape.iri in way or any(_cyclic(s, (*way, shape.iri)) for s in _inner(shape))


LOGIC = ("class", "node", "and", "or", "xone", "not")


class Table:
    """Verdicts of acyclic shapes as Boolean algebra over counts by node.

    A count is a column of the aggregate by subject (``own``) or of one over the values of paths (``held``); each has a
    name and is asked for by ``_count``, which gives zero where a node has no quads.
    """

    def __init__(self, validator: Validator):
        self.v, self.q = validator, validator.q

    def report(self, targets: list[Shape]) -> DataFrame:
        if not targets:
            return self.q.sparkSession.createDataFrame([], REPORT)
        node, found = F.col("node"), []
        self.own: dict[str, Column] = {}
        self.held: dict[str, tuple[str, Shape, str]] = {}
        for t in targets:
            is_focus = self._own(f"focus {t.iri}", (F.col("p") == TYPE) & (F.col("o") == t.iri)) > 0
            found += [(F.when(is_focus, x[0]) if x[0] is not None else None, *x[1:]) for x in self._told(t, node)]
        at_focus = [x for x in found if x[0] is not None]
        counts = self._counts(self.own, self.held)
        parts = []
        if at_focus:
            said = F.array_compact(F.array(*(F.when(c, F.struct(*self._said(shape, component, message, value))) for c, shape, component, message, value in at_focus)))
            parts.append(counts.select(F.col("node").alias("focus_node"), F.inline(said)))
        values = [(t, p) for t in targets for p in self._paths(t) if self.v.tests(p.params) or any(k in p.params for k in LOGIC)]
        if values:
            parts.append(self._of_values(values))
        closed = [t for t in targets if t.params.get("closed") == "true" and t.params.get("deactivated") != "true"]
        for t in closed:
            focus = self.v.types.where(F.col("class") == t.iri).select(F.col("node").alias("focus"))
            parts += [x.select(*FIELDS) for x in self.v.violations(Shape(t.iri, params={k: x for k, x in t.params.items() if k in ("closed", "ignoredProperties")}, properties=t.properties), focus, frozenset({p.iri for p in t.properties}))]
        out = None
        for p in parts:
            p = p.select(*FIELDS)
            out = p if out is None else out.unionByName(p)
        return self.q.sparkSession.createDataFrame([], REPORT) if out is None else out

    def _said(self, shape: Shape, component: str, message: str, value: Column | None) -> list[Column]:
        return [
            F.lit(shape.path).cast("string").alias("result_path"), (value if value is not None else F.lit(None)).cast("string").alias("value"), F.lit(shape.iri).alias("source_shape"),
            F.lit(SH + component + "ConstraintComponent").alias("component"), F.lit(message).alias("message"), F.lit("Violation").alias("severity"),
        ]

    def _paths(self, shape: Shape) -> list[Shape]:
        """The property shapes of a focus node's own shape."""
        if shape.params.get("deactivated") == "true":
            return []
        return [shape] if shape.path is not None else [p for s in shape.properties for p in self._paths(s)]

    # counts

    def _own(self, name: str, holds: Column) -> Column:
        self.own.setdefault(name, holds)
        return F.coalesce(F.col(f"`{name}`"), F.lit(0))

    def _held(self, name: str, path: str, shape: Shape, kind: str) -> Column:
        self.held.setdefault(name, (path, shape, kind))
        return F.coalesce(F.col(f"`{name}`"), F.lit(0))

    def _counts(self, own: dict[str, Column], held: dict[str, tuple[str, Shape, str]]) -> DataFrame:
        """node and its counts; null where a node has no such quads."""
        out = None
        if own:
            some = F.lit(False)
            for holds in own.values():
                some = some | F.coalesce(holds, F.lit(False))
            # rows that no count is about stay behind at the scan
            out = self.q.where(some).groupBy(F.col("s").alias("node")).agg(*(F.count_if(holds).alias(name) for name, holds in own.items()))
        if held:
            inner = Table(self.v)
            inner.own, inner.held = {}, {}
            bad = {name: (path, kind, inner._values_fail(shape, F.col("o")) if kind == "bad" else inner._conforms(shape.params["qualifiedValueShape"], F.col("o"), F.col("o_datatype"))) for name, (path, shape, kind) in held.items()}
            values = self.q.where(F.col("p").isin(sorted({x[0] for x in bad.values()}))).select("s", "p", "o", "o_kind", "o_datatype")
            below = inner._counts(inner.own, inner.held)
            if below is not None:
                values = values.join(below, (F.col("o") == F.col("node")) & (F.col("o_kind") != "literal"), "left")
            more = values.groupBy(F.col("s").alias("node")).agg(*(F.count_if((F.col("p") == path) & test).alias(name) for name, (path, _, test) in bad.items()))
            out = more if out is None else out.join(more, "node", "full")
        return out

    # verdicts

    def _conforms(self, shape: Shape, node: Column, datatype: Column | None = None) -> Column:
        """Whether a node conforms to a shape. A value's own datatype is known where it is one."""
        if shape.params.get("deactivated") == "true":
            return F.lit(True)
        out = F.lit(True)
        if shape.path is None and "datatype" in shape.params and datatype is not None:
            out = F.coalesce(datatype == shape.params["datatype"], F.lit(False))
        if shape.path is not None:
            tests = [holds for _, holds, _ in self.v.tests(shape.params)]
            if tests:
                fails = tests[0]
                for x in tests[1:]:
                    fails = fails | x
                out = out & (self._own(f"bad {shape.iri}", (F.col("p") == shape.path) & fails) == 0)
            if any(k in shape.params for k in LOGIC):
                out = out & (self._held(f"bad values {shape.iri}", shape.path, shape, "bad") == 0)
        for failed, *_ in self._told(shape, node):
            if failed is not None:
                out = out & ~failed
        for p in shape.properties if shape.path is None else []:
            out = out & self._conforms(p, node)
        if shape.path is None and shape.params.get("closed") == "true":
            allowed = [TYPE, *shape.params.get("ignoredProperties", []), *(p.path for p in shape.properties if p.path)]
            out = out & (self._own(f"closed {shape.iri}", ~F.col("p").isin(allowed)) == 0)
        return out

    def _told(self, shape: Shape, node: Column) -> list[tuple[Column, Shape, str, str, Column | None]]:
        """(is violated, shape, component, message, value) of what is told of a focus node by its counts; not of single values."""
        p, out = shape.params, []
        if p.get("deactivated") == "true":
            return out
        if shape.path is None:
            out += [x for s in shape.properties for x in self._told(s, node)]
            if p.get("in"):
                out.append((~node.isin(p["in"]), shape, "In", "must be one of the allowed values", node))
            out += [(node != v, shape, "HasValue", f"must have value {v}", None) for v in p.get("hasValue", [])]
            return out + self._logic(shape, node)
        if "minCount" in p or "maxCount" in p:
            n = self._own(f"n {shape.path}", F.col("p") == shape.path)
            if "minCount" in p:
                out.append((n < int(p["minCount"]), shape, "MinCount", f"must have at least {p['minCount']} value(s)", None))
            if "maxCount" in p:
                out.append((n > int(p["maxCount"]), shape, "MaxCount", f"must have at most {p['maxCount']} value(s)", None))
        out += [(self._own(f"has {shape.path} {v}", (F.col("p") == shape.path) & (F.col("o") == v)) == 0, shape, "HasValue", f"must have value {v}", None) for v in p.get("hasValue", [])]
        if "qualifiedValueShape" in p:
            n = self._held(f"qualified {shape.iri}", shape.path, shape, "qualified")
            if "qualifiedMinCount" in p:
                out.append((n < int(p["qualifiedMinCount"]), shape, "QualifiedMinCount", f"must have at least {p['qualifiedMinCount']} conforming value(s)", None))
            if "qualifiedMaxCount" in p:
                out.append((n > int(p["qualifiedMaxCount"]), shape, "QualifiedMaxCount", f"must have at most {p['qualifiedMaxCount']} conforming value(s)", None))
        return out

    def _logic(self, shape: Shape, node: Column) -> list[tuple[Column, Shape, str, str, Column | None]]:
        p, out = shape.params, []
        for c in p.get("class", []):
            out.append((self._own(f"is {c}", (F.col("p") == TYPE) & (F.col("o") == c)) == 0, shape, "Class", f"must be an instance of {c}", node))
        out += [(~self._conforms(s, node), shape, "Node", f"must conform to {s.iri}", node) for s in p.get("node", [])]
        out += [(~self._conforms(s, node), shape, "And", f"must conform to {s.iri}", node) for g in p.get("and", []) for s in g]
        for g in p.get("or", []):
            some = F.lit(False)
            for s in g:
                some = some | self._conforms(s, node)
            out.append((~some, shape, "Or", "must conform to at least one shape", node))
        for g in p.get("xone", []):
            n = sum((self._conforms(s, node).cast("int") for s in g), F.lit(0))
            out.append((n != 1, shape, "Xone", "must conform to exactly one shape", node))
        out += [(self._conforms(s, node), shape, "Not", f"must not conform to {s.iri}", node) for s in p.get("not", [])]
        return out

    def _values_fail(self, shape: Shape, value: Column) -> Column:
        out = F.lit(False)
        for failed, *_ in self._logic(shape, value):
            out = out | failed
        return out

    def _of_values(self, wanted: list[tuple[Shape, Shape]]) -> DataFrame:
        """Violations of single values: the values of all paths in one pass, joined to the types of their subjects and, where shapes are asked of them, to their own counts."""
        inner = Table(self.v)
        inner.own, inner.held = {}, {}
        told = []
        for target, p in wanted:
            mine = F.array_contains("_targets", target.iri) & (F.col("p") == p.path)
            told += [(mine & fails, p, component, message, F.col("o")) for component, fails, message in self.v.tests(p.params)]
            told += [(mine & failed, p, component, message, F.col("o")) for failed, _, component, message, _ in inner._logic(p, F.col("o"))]
        classes = sorted({t.iri for t, _ in wanted})
        focus = self.q.where((F.col("p") == TYPE) & F.col("o").isin(classes)).groupBy("s").agg(F.collect_set("o").alias("_targets"))
        values = self.q.where(F.col("p").isin(sorted({p.path for _, p in wanted}))).select("s", "p", "o", "o_kind", "o_datatype").join(focus, "s")
        below = inner._counts(inner.own, inner.held)
        if below is not None:
            values = values.join(below, (F.col("o") == F.col("node")) & (F.col("o_kind") != "literal"), "left")
        said = F.array_compact(F.array(*(F.when(c, F.struct(*self._said(shape, component, message, value))) for c, shape, component, message, value in told)))
        return values.select(F.col("s").alias("focus_node"), F.inline(said))


def validate(shapes: DataFrame, quads: DataFrame) -> DataFrame:
    """The report of a shapes graph (itself quads, and schema-sized) over a quads table."""
    rows = [(r["s"], r["p"], r["o"], r["o_kind"]) for r in shapes.select("s", "p", "o", "o_kind").toLocalIterator()]
    return Validator(parse_shapes(rows), quads).report()
