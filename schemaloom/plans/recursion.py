"""Recursive schemas over VARIANT documents, level by level within the row.

A schema that refers back to itself is a table of nodes, one for each schema that a recursive reference leads to. A
document is looked at from the root down: a level is an array of calls (node, path, depth, value), and the next level
holds the calls that those make, each once. Then verdicts are folded from the deepest level up: a node is checked by an
ordinary expression, in which a call is a look into what the level below has found to fail. Both loops are aggregates
over arrays, so the plan has each node's expression twice however deep documents go, the work of a document is linear in
its calls, and validation stays a narrow map without a shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rounds import let, rounds
from .compiler import ERROR, Compiler, Test, _At, any_of, matching, no_errors
from .registry import Registry, Schema, subschemas
from .values import Known, Opened, Placed, Value, Variant

CALL = "struct<node:int,path:string,depth:int,value:variant>"
LEVEL = f"array<{CALL}>"
#: Keywords that ask for a value's kind or number.
SCALARS = {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format"}
MEMBERS = "map<string,variant>"
#: A call whose value is opened, once for both ways.
OPEN = f"struct<node:int,path:string,depth:int,value:variant,members:{MEMBERS}>"


def _targets(registry: Registry, doc: str, schema: Schema) -> list[tuple[str, Schema]]:
    """Where the references within a schema lead: (document, schema)."""
    out = []
    for _, s in subschemas(schema):
        if not isinstance(s, dict):
            continue
        for k in ("$ref", "$dynamicRef", "rdfs:range"):
            ref = s.get(k)
            ref = ref.get("$ref") if isinstance(ref, dict) else ref
            if not isinstance(ref, str) or k == "rdfs:range" and not registry.has(ref.partition("#")[0] or doc):
                continue
            out.append(registry.resolve(ref, doc))
            if k == "$dynamicRef":  # whichever document is outermost may decide
                name = ref.partition("#")[2]
                out += [(d, x) for d in registry for _, x in subschemas(registry[d]) if isinstance(x, dict) and x.get("$dynamicAnchor") == name]
    return out


def cyclic(registry: Registry, key: str) -> set[int]:
    """The schemas (by identity) that a reference reachable from ``key`` leads to and that lead back to themselves."""
    steps: dict[int, set[int]] = {}
    todo = [(key, registry[key])]
    while todo:
        doc, schema = todo.pop()
        if id(schema) not in steps:
            found = _targets(registry, doc, schema)
            steps[id(schema)] = {id(t) for _, t in found}
            todo += found
    out = set()
    for start in steps:
        seen, front = set(), set(steps[start])
        while front:
            seen |= front
            front = set().union(*(steps[x] for x in front)) - seen
        if start in seen:
            out.add(start)
    return out


class Call(NamedTuple):
    """A node that is evaluated by itself, on a value below the one at hand."""

    node: int


class Levels(Compiler):
    """Compiles one recursive schema; ``check`` and ``errors`` take a VARIANT document."""

    def __init__(self, base: Compiler, key: str, found: set[int]):
        super().__init__(base.registry, base.formats, base.max_depth, base.assert_formats, base.ignore_additional)
        self.cyclic = found
        self.leading: dict[int, bool] = {}
        self.numbers: dict[tuple, int] = {}
        self.nodes: list[tuple[Schema, _At]] = []
        self.root: Value | None = None
        self._node(self.registry[key], _At(key))
        for i, _ in enumerate(self.nodes):  # grows as calls are met
            self._calls_of(i, F.lit(None).cast(OPEN))

    # nodes

    def _node(self, schema: Schema, at: _At) -> Call:
        at = _At(at.root, frozenset(), tuple(dict.fromkeys(at.scope)))
        key = (id(schema), at.root, at.scope)
        if key not in self.numbers:
            self.numbers[key] = len(self.nodes)
            self.nodes.append((schema, at))
        return Call(self.numbers[key])

    def _leads(self, s: Schema, doc: str) -> bool:
        """Whether a schema leads to a recursive one."""
        if id(s) not in self.leading:
            self.leading[id(s)] = False  # while its own references are followed
            self.leading[id(s)] = any(id(t) in self.cyclic or self._leads(t, d) for d, t in _targets(self.registry, doc, s))
        return self.leading[id(s)]

    def _apart(self, s: Schema, v: Value, at: _At) -> Call | None:
        """The node of a schema that needs the evaluated keys of a recursive one, on a nested value."""
        nested = isinstance(v, Placed) and v is not self.root and isinstance(s, dict)
        return self._node(s, at) if nested and ("unevaluatedProperties" in s or "unevaluatedItems" in s) and self._leads(s, at.root) else None

    def _ref(self, s: dict, v: Value, at: _At):
        found = self._target(s, at)
        if found and isinstance(v, Placed) and v is not self.root and id(found[2]) in self.cyclic:
            return self._node(found[2], _At(found[1], scope=(*at.scope, at.root))), at
        return super()._ref(s, v, at)

    # calls, from the root down

    def _calls(self, s: Schema, v: Value, at: _At) -> list[tuple[int, Column]]:
        """(node, array of calls) of each place of a schema that a recursive reference is at."""
        if isinstance(s, Call) or (s_apart := self._apart(s, v, at)):
            node = (s if isinstance(s, Call) else s_apart).node
            deep = self.here["depth"] + at.level
            call = F.struct(F.lit(node).alias("node"), v.path.alias("path"), deep.cast("int").alias("depth"), v.col.alias("value"))
            return [(node, F.when(v.present() & (deep < self.max_depth), F.array(call)).otherwise(F.array().cast(LEVEL)))]
        if not isinstance(s, dict) or not self._leads(s, at.root):
            return []
        at = at._replace(level=at.level + 1)
        out: list[tuple[int, Column]] = []
        if ref := self._ref(s, v, at):
            out += self._calls(ref[0], v, ref[1])
        for k, sub in s.get("properties", {}).items():
            out += self._calls(sub, v.get(k), at)
        out += [x for p, sub in s.get("patternProperties", {}).items() for x in self._each_key(sub, v, matching(v.keys(), p), at)]
        if isinstance(extra := self._extra(s), dict):
            out += self._each_key(extra, v, self._extra_keys(s, v), at)
        if isinstance(sub := s.get("unevaluatedProperties"), dict):
            out += self._each_key(sub, v, v.keys(), at)
        for i, sub in enumerate(s.get("prefixItems", [])):
            out += self._calls(sub, v.item(F.get(v.items(), i)), at)
        for k in ("items", "contains", "unevaluatedItems"):
            out += self._each(s.get(k), v.items(), v.item, at)
        same = [*s.get("dependentSchemas", {}).values(), *s.get("allOf", []), *s.get("anyOf", []), *s.get("oneOf", []), *(s[k] for k in ("not", "if", "then", "else") if k in s)]
        for m in same:
            out += self._calls(m, v, at)
        if (target := s.get("rdfs:range")) is not None and (r := self._range(target, v, at)):
            out += self._calls(r[0], v, r[1])
        return out

    def _each(self, sub: Schema | None, values: Column, item, at: _At) -> list[tuple[int, Column]]:
        found: list[int] = []

        def one(x: Column) -> Column:
            made = self._calls(sub, item(x), at)
            found.extend(n for n, _ in made)
            return F.concat(*(c for _, c in made)) if made else F.array().cast(LEVEL)

        if not isinstance(sub, dict):
            return []
        made = F.coalesce(F.flatten(F.transform(values, one)), F.array().cast(LEVEL))
        return [(n, made if i == 0 else F.array().cast(LEVEL)) for i, n in enumerate(found)]

    def _each_key(self, sub: Schema, v: Value, keys: Column, at: _At) -> list[tuple[int, Column]]:
        return self._each(sub, keys, v.lookup, at)

    def _calls_of(self, i: int, call: Column) -> Column:
        """The calls that a call of node i makes, each once."""
        schema, at = self.nodes[i]
        self._enter(call)
        made = self._calls(schema, self.root, at)
        if not made:
            return F.array().cast(LEVEL)
        calls = self._joined([c for _, c in made]) if len(made) > 1 else made[0][1]
        if len({n for n, _ in made}) == len(made):
            return calls
        first = lambda calls, keys: F.filter(calls, lambda c, j: F.array_position(keys, _key(c)) == j + 1)
        once = lambda calls: let(F.transform(calls, _key), lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), calls).otherwise(first(calls, keys)))
        return let(calls, lambda calls: F.when(F.size(calls) < 2, calls).otherwise(once(calls)))

    def _enter(self, call: Column) -> None:
        self.here, self.root = call, Opened(call["value"], call["path"], call["members"])

    def _by_node(self, call: Column, made) -> Column:
        out = None
        for i in range(len(self.nodes)):
            out = F.when(call["node"] == i, made(i)) if out is None else out.when(call["node"] == i, made(i))
        return made(0) if len(self.nodes) == 1 else out

    def levels(self, value: Variant) -> Column:
        """The calls of a document by level, the deepest first."""
        root = F.struct(F.lit(0).alias("node"), F.lit("").alias("path"), F.lit(0).alias("depth"), value.col.alias("value"))
        none = F.array().cast(f"array<array<{OPEN}>>")
        opened = lambda c: F.struct(*(c[x].alias(x) for x in ("node", "path", "depth", "value")), F.try_variant_get(c["value"], "$", MEMBERS).alias("members"))
        start = F.struct(F.array(root).alias("now"), none.alias("done"))

        def down(state: Column) -> Column:
            following = lambda now: F.flatten(F.transform(now, lambda c: self._by_node(c, lambda i: self._calls_of(i, c))))
            return let(F.transform(state["now"], opened), lambda now: F.struct(following(now).alias("now"), F.concat(F.array(now), state["done"]).alias("done")))

        return rounds(start, lambda state: F.size(state["now"]) > 0, down, self.max_depth + 1)["done"]

    # verdicts, from the deepest level up

    def _plain(self, s: Schema, v: Value) -> bool:
        """Whether a value below the one at hand is asked for its kind or number, and has to find them out each time."""
        return isinstance(s, dict) and not SCALARS.isdisjoint(s) and isinstance(v, Placed) and not isinstance(v, (Known, Opened))

    def _check(self, s: Schema, v: Value, at: _At) -> Column:
        if self._plain(s, v):
            return Known.held(v, lambda x: self._check(s, Known(x, v.path), at))
        if isinstance(s, Call) or (s_apart := self._apart(s, v, at)):
            return ~self._failed(_key_of((s if isinstance(s, Call) else s_apart).node, v))
        if isinstance(s, bool):
            return super()._check(s, v, at)
        out = super()._check(s, v, at._replace(level=at.level + 1))
        return out if at.level == 0 else (self.here["depth"] + at.level >= self.max_depth) | out

    def _parts_of(self, s: Schema, v: Value, at: _At) -> list[tuple[Column, bool]]:
        return [(self._check(s, v, at), False)]

    def _errors(self, s: Schema, v: Value, path: Column, at: _At) -> Column:
        if self._plain(s, v):
            return Known.held(v, lambda x: self._errors(s, Known(x, v.path), path, at))
        if isinstance(s, Call) or (s_apart := self._apart(s, v, at)):
            found = lambda key: F.coalesce(F.get(F.filter(self.below, lambda r: r["key"] == key), 0)["errors"], no_errors())
            return F.when(F.size(self.below) == 0, no_errors()).otherwise(let(_key_of((s if isinstance(s, Call) else s_apart).node, v), found))
        if isinstance(s, bool):
            return super()._errors(s, v, path, at)
        out = super()._errors(s, v, path, at._replace(level=at.level + 1))
        return out if at.level == 0 else F.when(self.here["depth"] + at.level >= self.max_depth, no_errors()).otherwise(out)

    def _collect(self, tests: list[Test], path: Column) -> Column:
        """The errors of tests, gathered only where one fails."""
        return F.when(any_of([t.fails for t in tests]), super()._collect(tests, path)).otherwise(no_errors())

    def _joined(self, parts: list[Column]) -> Column:
        return F.flatten(F.array(*parts))  # within a row less work than a concat

    def _at_node(self, i: int, call: Column) -> tuple[Schema, Value, _At]:
        self._enter(call)
        return self.nodes[i][0], self.root, self.nodes[i][1]

    def check(self, value: Variant) -> Column:
        def up(failed: Column, level: Column) -> Column:
            self._failed = lambda key: F.array_contains(failed, key)
            bad = F.filter(level, lambda c: ~self._by_node(c, lambda i: self._check(*self._at_node(i, c))))
            return F.transform(bad, _key)

        return F.size(F.aggregate(self.levels(value), F.array().cast("array<string>"), up)) == 0

    def errors(self, value: Variant) -> Column:
        result = f"array<struct<key:string,errors:array<{ERROR}>>>"

        def of(i: int, call: Column) -> Column:
            schema, root, at = self._at_node(i, call)
            return self._errors(schema, root, root.path, at)

        def up(found: Column, level: Column) -> Column:
            self.below, self._failed = found, lambda key: F.exists(found, lambda r: r["key"] == key)
            made = F.transform(level, lambda c: F.struct(_key(c).alias("key"), self._by_node(c, lambda i: of(i, c)).alias("errors")))
            return F.filter(made, lambda r: F.size(r["errors"]) > 0).cast(result)

        end = F.aggregate(self.levels(value), F.array().cast(result), up)
        return F.coalesce(F.get(end, 0)["errors"], no_errors())


def _key(call: Column) -> Column:
    return F.concat(call["node"].cast("string"), call["path"])


def _key_of(node: int, v: Placed) -> Column:
    return F.concat(F.lit(str(node)), v.path)
