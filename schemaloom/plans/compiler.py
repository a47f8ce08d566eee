"""JSON Schema to Columns: ``check`` gives a boolean, ``errors`` an array of error structs.

The plan is built once on the driver and is an ordinary expression, so validation is a narrow map that Catalyst
optimises, pushes down and generates code for. References are inlined. Recursive ones are followed as deep as a typed
column's type goes; in VARIANT documents they are evaluated level by level (see ``recursion``), in a plan whose size
doesn't depend on the documents. A reference that comes back to the same node is valid, and so is a node that lies
``max_depth`` schemas deep.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import Formats, strict_json
from ..functions.hashing import number_text, text
from .registry import Registry, Schema, config, ext, subschemas
from .values import NUMERIC, Typed, Value, Variant

ERROR = "struct<path:string,keyword:string,message:string,params:map<string,string>>"
EPSILON = 2.220446049250313e-15
NO_STRINGS = "array<string>"
#: Fixed value: the vocabulary by which a document turns the assertion of formats on or off.
FORMAT_VOCABULARY = "https://json-schema.org/draft/2020-12/vocab/format-assertion"
#: Fixed value: how many schemas deep a document is looked into.
MAX_DEPTH = 100


class Test(NamedTuple):
    """One assertion of a node: it fails where ``fails`` is true.

    ``holds`` says the same of a typed column in a form that scans take as a filter; it is null for an absent value.
    """

    keyword: str
    fails: Column
    message: str | Column
    params: dict[str, Any]
    holds: Column | None = None


def regex(pattern: str) -> str:
    """An ECMAScript pattern for Java's engine: $ is the very end, / needs no escape, [^] is any character, \\s also means
    Unicode's spaces, and code points may stand in braces."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        if pattern.startswith("[^]", i) and not inside:
            out.append(r"[\s\S]")
            i += 3
            continue
        if pattern[i] == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            if e == "u" and pattern[i + 2 : i + 3] == "{":
                out.append("\\x")
            elif e == "s":
                out.append(r"\s\p{Z}\uFEFF" if inside else r"[\s\p{Z}\uFEFF]")
            elif e == "S" and not inside:
                out.append(r"[^\s\p{Z}\uFEFF]")
            else:
                out.append("/" if e == "/" else pattern[i : i + 2])
            i += 2
            continue
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        out.append(r"\z" if pattern[i] == "$" and not inside else pattern[i])
        i += 1
    return "".join(out)


def matching(keys: Column, pattern: str) -> Column:
    if re.fullmatch(r"\^[A-Za-z0-9_-]+", pattern):  # a plain beginning
        return F.filter(keys, lambda k: k.startswith(pattern[1:]))
    return F.filter(keys, lambda k: k.rlike(regex(pattern)))


def one_error(path: Column, keyword: str, message: str | Column, params: dict[str, Any]) -> Column:
    kv = [F.lit(x) if not isinstance(x, Column) else x for k, v in params.items() for x in (k, v if isinstance(v, (str, Column)) else text(v))]
    made = F.create_map(*kv).cast("map<string,string>") if kv else F.lit(None).cast("map<string,string>")
    return F.struct(path.alias("path"), F.lit(keyword).alias("keyword"), (message if isinstance(message, Column) else F.lit(message)).alias("message"), made.alias("params"))


def no_errors() -> Column:
    return F.array().cast(f"array<{ERROR}>")


def any_of(tests: list[Column], empty: bool = False) -> Column:
    out = None
    for t in tests:
        out = t if out is None else out | t
    return F.lit(empty) if out is None else out


def all_of(tests: list[Column]) -> Column:
    out = None
    for t in tests:
        out = t if out is None else out & t
    return F.lit(True) if out is None else out


#: Compiled checks and errors of whole rows, by what they were compiled from; the oldest go first.
KEPT: OrderedDict[tuple, Column] = OrderedDict()
MAX_KEPT = 512


class Compiler:
    def __init__(self, registry: Registry, formats: Formats | None = None, max_depth: int = MAX_DEPTH, assert_formats: bool = True, ignore_additional: bool = False):
        self.registry = registry
        self.formats = formats or Formats()
        self.max_depth = max_depth
        self.assert_formats = assert_formats
        self.ignore_additional = ignore_additional

    # entry points

    def check(self, schema_id: str, value: Value) -> Column:
        key = self.registry.expand(schema_id)
        if levels := self._levels(key, value):
            return levels.check(value)
        valid = self._check(self.registry[key], value, _At(key))
        return F.coalesce(valid, F.lit(True)) if isinstance(value, Typed) and not isinstance(value.kind, T.StructType) else valid

    def kept(self, what: str, schema_id: str, value: Value, kind: T.DataType) -> Column:
        """``check`` or ``errors`` of a row of named columns, compiled once for its type and all that the schema refers to.

        Schemas with functions of the user's own are compiled each time, since these can't be told apart.
        """
        registry = self.registry
        key = registry.expand(schema_id)
        make = self.check if what == "check" else self.errors
        if registry.keywords or any(k in registry.invariants for k in registry.reachable(key)) or type(self.formats) is not Formats or self.formats.changed:
            return make(key, value)
        name = (id(SparkContext._gateway), what, key, registry.semantic_hash(key, exact=True), kind.json(), self.max_depth, self.assert_formats, self.ignore_additional)
        if name not in KEPT:
            KEPT[name] = make(key, value)
            while len(KEPT) > MAX_KEPT:
                KEPT.popitem(last=False)
        KEPT.move_to_end(name)
        return KEPT[name]

    def _levels(self, key: str, value: Value):
        """The evaluation by levels, where the value is a VARIANT document and the schema refers back to itself."""
        from .recursion import Levels, cyclic

        found = cyclic(self.registry, key) if isinstance(value, Variant) else set()
        return Levels(self, key, found) if found else None

    def errors(self, schema_id: str, value: Value) -> Column:
        """Structural errors; where there are none, disjointness; where there is none either, invariants."""
        key = self.registry.expand(schema_id)
        schema = self.registry[key]
        levels = self._levels(key, value)
        found = levels.errors(value) if levels else self._errors(schema, value, F.lit(""), _At(key))
        later = [self._disjoint(schema, value, key)]
        for name, column in self.registry.invariants.get(key, {}).items():
            message = column(value)
            later.append(F.when(message.isNotNull(), F.array(one_error(F.lit(""), "invariant", message, {"invariant": name}))).otherwise(no_errors()))
        for more in later:
            if more is not None:
                found = F.when(F.size(found) > 0, found).otherwise(more)
        return found

    def _disjoint(self, schema: Schema, value: Value, key: str) -> Column | None:
        targets = schema.get("disjointWith", []) if isinstance(schema, dict) else []
        targets = [targets] if isinstance(targets, (str, dict)) else targets
        tests = []
        for t in targets:
            target = t["$ref"] if isinstance(t, dict) else t
            if self.registry.has(target):
                fails = self._check(self.registry[target], value, _At(self.registry.expand(target)))
                tests.append(Test("disjointWith", fails, f"must NOT satisfy disjoint schema '{target}'", {"disjointWith": target}))
            else:
                tests.append(Test("disjointWith", F.lit(True), f"disjoint schema '{target}' is not registered", {"disjointWith": target}))
        return self._collect(tests, F.lit("")) if tests else None

    # tests without children; fixed values: the messages and the names of parameters, here and below

    def _scalars(self, s: dict, v: Value, at: _At) -> Iterator[Test]:
        if "type" in s:
            types = [s["type"]] if isinstance(s["type"], str) else s["type"]
            said = f"must be {types[0]}" if len(types) == 1 else f"must be one of: {', '.join(types)}"
            fits = any_of([v.is_type(t) for t in types])
            yield Test("type", ~fits, said, {"type": types[0] if len(types) == 1 else types}, fits if isinstance(v, Typed) else None)
        if "enum" in s:
            yield Test("enum", ~self._among(v, s["enum"]), "must be one of the allowed values", {"allowedValues": s["enum"]}, self._plainly_among(v, s["enum"]))
        if "const" in s:
            yield Test("const", ~self._among(v, [s["const"]]), f"must be {text(s['const'], sort=False)}", {"allowedValue": s["const"]}, self._plainly_among(v, [s["const"]]))
        n = v.number()
        number = lambda c: F.coalesce(c, F.lit(False))
        for k, fails, sign in (("minimum", lambda x, b: x < b, ">="), ("maximum", lambda x, b: x > b, "<="), ("exclusiveMinimum", lambda x, b: x <= b, ">"), ("exclusiveMaximum", lambda x, b: x >= b, "<")):
            if k in s:
                b = F.lit(float(s[k]))
                holds = {">=": n >= b, "<=": n <= b, ">": n > b, "<": n < b}[sign] if isinstance(v, Typed) and isinstance(v.kind, NUMERIC) else None
                yield Test(k, number(fails(n, b)), f"must be {sign} {number_text(s[k])}", {"limit": s[k]}, holds)
        if "multipleOf" in s:
            d = float(s["multipleOf"])
            q = n / F.lit(d) if d else None
            fails = number(F.abs(q - F.floor(q + 0.5)) > EPSILON) if d else n.isNotNull()
            yield Test("multipleOf", fails, f"must be a multiple of {number_text(s['multipleOf'])}", {"multipleOf": s["multipleOf"]})
        t = v.text()
        for k, fails, said in (("minLength", lambda n_, b: n_ < b, "fewer"), ("maxLength", lambda n_, b: n_ > b, "more")):
            if k in s:
                yield Test(k, number(fails(F.char_length(t), int(s[k]))), f"must NOT have {said} than {number_text(s[k])} characters", {"limit": s[k]})
        if "pattern" in s:
            yield Test("pattern", number(~t.rlike(regex(s["pattern"]))), f'must match pattern "{s["pattern"]}"', {"pattern": s["pattern"]})
        if self._formats_asserted(at):
            yield from self._contents(s, v, t, n, number)
        for name, (column, only) in self.registry.keywords.items():
            if name in s:
                applies = v.is_type(only) if only else v.present()
                yield Test(name, applies & ~F.coalesce(column(v, s[name]), F.lit(False)), f'must pass "{name}" validation', {})

    def _contents(self, s, v, t, n, known) -> Iterator[Test]:
        if "format" in s and (found := self.formats.get(s["format"])):
            kind, check = found
            fails = known(~F.coalesce(check(t), F.lit(False))) & t.isNotNull() if kind == "string" else known(~check(n)) & n.isNotNull()
            yield Test("format", fails, f'must match format "{s["format"]}"', {"format": s["format"]})
        encoding = s.get("contentEncoding")
        plain = t
        if encoding in ("base64", "base64url"):
            decoded = F.try_to_binary(F.translate(t, "-_", "+/") if encoding == "base64url" else t, F.lit("base64"))
            yield Test("contentEncoding", t.isNotNull() & decoded.isNull(), f"must be valid {encoding}-encoded content", {"encoding": encoding})
            plain = F.decode(decoded, "UTF-8")
        if s.get("contentMediaType") == "application/json":
            yield Test("contentMediaType", t.isNotNull() & strict_json(plain).isNull(), "must be valid application/json content", {"mediaType": "application/json"})

    def _among(self, v: Value, allowed: list) -> Column:
        """Deep equality with one of some constants; plain comparisons where the column's type allows, so that they push down."""
        if isinstance(v, Typed):
            strings = [a for a in allowed if isinstance(a, str)]
            if isinstance(v.kind, T.StringType):
                return F.coalesce(v.col.isin(strings), F.lit(False)) if strings else F.lit(False)
            numbers = [float(a) for a in allowed if isinstance(a, (int, float)) and not isinstance(a, bool)]
            if isinstance(v.kind, (T.IntegerType, T.LongType, T.DoubleType, T.ShortType, T.FloatType)):
                return F.coalesce(v.number().isin(numbers), F.lit(False)) if numbers else F.lit(False)
        return F.coalesce(v.canonical().isin([text(a) for a in allowed]), F.lit(False))

    def _plainly_among(self, v: Value, allowed: list) -> Column | None:
        if isinstance(v, Typed) and isinstance(v.kind, T.StringType) and (strings := [a for a in allowed if isinstance(a, str)]):
            return v.col.isin(strings)
        if isinstance(v, Typed) and isinstance(v.kind, NUMERIC) and (numbers := [float(a) for a in allowed if isinstance(a, (int, float)) and not isinstance(a, bool)]):
            return v.number().isin(numbers)
        return None

    # children

    def _children(self, s: dict, v: Value, at: _At) -> Iterator[tuple[Column | None, Schema, Value, str, _At]]:
        """(guard, schema, child, path step) of the properties that a struct's or object's keys name outright."""
        for k, sub in s.get("properties", {}).items():
            yield None, sub, v.get(k), k, at

    def _object_tests(self, s: dict, v: Value) -> Iterator[Test]:
        is_object = v.is_type("object")
        for k in s.get("required", []):
            has = self._has(s, v, k)
            yield Test("required", is_object & ~has, f"must have required property '{k}'", {"missingProperty": k}, ~is_object | has)
        if "minProperties" in s:
            yield Test("minProperties", is_object & F.coalesce(F.size(v.keys()) < s["minProperties"], F.lit(False)), f"must NOT have fewer than {s['minProperties']} properties", {"limit": s["minProperties"]})
        if "maxProperties" in s:
            yield Test("maxProperties", is_object & F.coalesce(F.size(v.keys()) > s["maxProperties"], F.lit(False)), f"must NOT have more than {s['maxProperties']} properties", {"limit": s["maxProperties"]})

    def _has(self, s: dict, v: Value, key: str) -> Column:
        alias = ext(s.get("properties", {}).get(key, {}), "alias")
        return v.get(key).present() | v.get(alias).present() if isinstance(alias, str) else v.get(key).present()

    def _dependents(self, s: dict, v: Value) -> Iterator[Test]:
        for k, needs in s.get("dependentRequired", {}).items():
            for d in needs:
                yield Test("dependentRequired", v.is_type("object") & v.get(k).present() & ~v.get(d).present(), f"must have property '{d}' when '{k}' is present", {"missingProperty": d, "property": k})

    def _extra_keys(self, s: dict, v: Value) -> Column:
        """Keys that neither properties (or their aliases) nor patternProperties cover."""
        known = [*s.get("properties", {}), *(a for p in s.get("properties", {}).values() if isinstance(a := ext(p, "alias"), str))]
        keys = F.array_except(v.keys(), F.array(*map(F.lit, known)).cast(NO_STRINGS))
        for p in s.get("patternProperties", {}):
            keys = F.array_except(keys, matching(keys, p))
        return keys

    def _array_tests(self, s: dict, v: Value, at: _At) -> Iterator[Test]:
        items = v.items() if not isinstance(v, Typed) or isinstance(v.kind, T.ArrayType) else None
        if items is None:
            return
        known = lambda c: F.coalesce(v.is_type("array") & c, F.lit(False))
        n = F.size(items)
        if "minItems" in s:
            yield Test("minItems", known(n < s["minItems"]), f"must have at least {s['minItems']} items", {"limit": s["minItems"]})
        if "maxItems" in s:
            yield Test("maxItems", known(n > s["maxItems"]), f"must have at most {s['maxItems']} items", {"limit": s["maxItems"]})
        if s.get("uniqueItems"):
            texts = F.transform(items, lambda x: F.coalesce(v.item(x).canonical(), F.lit("null")))
            yield Test("uniqueItems", known(F.size(F.array_distinct(texts)) < n), "must NOT have duplicate items", {})
        if "contains" in s:
            found = F.size(F.filter(items, lambda x: self._check(s["contains"], v.item(x), at)))
            least = s.get("minContains", 1)
            said = f"must contain at least {least} matching items" if "minContains" in s or "maxContains" in s else "must contain at least one matching item"
            yield Test("contains", known(found < least), said, {"minContains": least})
            if "maxContains" in s:
                yield Test("maxContains", known(found > s["maxContains"]), f"must contain at most {s['maxContains']} matching items", {"maxContains": s["maxContains"]})

    def _target(self, s: dict, at: _At) -> tuple[str, str, Schema] | None:
        """(reference with its document, document, schema) of a node's reference."""
        for k in ("$ref", "$dynamicRef"):
            if k in s:
                doc, target = self._dynamic(s[k], at) if k == "$dynamicRef" else self.registry.resolve(s[k], at.root)
                return f"{doc}{s[k]}", doc, target
        return None

    def _ref(self, s: dict, v: Value, at: _At) -> tuple[Schema, _At] | None:
        found = self._target(s, at)
        if found is None:
            return None
        ref, doc, target = found
        here = f"{ref} {id(v)}"  # the values on the way are alive, so that their ids differ
        if here in at.seen or isinstance(v, Typed) and isinstance(v.kind, T.NullType):
            return True, at
        return target, _At(doc, at.seen | {here}, (*at.scope, at.root), at.level)

    def _dynamic(self, ref: str, at: _At) -> tuple[str, Schema]:
        """Where the reference leads by itself; if that is a dynamic anchor, the outermost document on the way that has an anchor of its name decides."""
        doc, target = self.registry.resolve(ref, at.root)
        name = ref.partition("#")[2]
        if isinstance(target, dict) and name and target.get("$dynamicAnchor") == name:
            for outer in (*at.scope, at.root):
                for _, s in subschemas(self.registry[outer]):
                    if isinstance(s, dict) and s.get("$dynamicAnchor") == name:
                        return outer, s
        return doc, target

    def _formats_asserted(self, at: _At) -> bool:
        """Formats are asserted unless the document's vocabulary says that they aren't."""
        root = self.registry[at.root] if self.registry.has(at.root) else {}
        said = (root.get("$vocabulary") or {}).get(FORMAT_VOCABULARY) if isinstance(root, dict) else None
        return said if isinstance(said, bool) and self.assert_formats else self.assert_formats

    # check

    def _check(self, s: Schema, v: Value, at: _At) -> Column:
        """True where the value is valid; an absent value is checked as if it weren't there by the caller."""
        return all_of([c for c, _ in self._parts(s, v, at)])

    def _parts(self, s: Schema, v: Value, at: _At) -> list[tuple[Column, bool]]:
        """The conditions that a valid value meets, each by itself, and whether a scan can take it as a filter."""
        if isinstance(s, bool):
            return [(F.lit(s), True)]
        plain: list[tuple[Column, bool]] = []
        parts: list[Column] = []
        if ref := self._ref(s, v, at):
            plain += self._parts_of(ref[0], v, ref[1])
        tests = [*self._scalars(s, v, at), *self._object_tests(s, v), *self._array_tests(s, v, at), *self._dependents(s, v)]
        plain += [(t.holds, True) if t.holds is not None else (~t.fails, False) for t in tests]
        is_object = v.is_type("object")
        for _, sub, child, _, own in self._children(s, v, at):
            # conditions of either kind are put differently, or else the optimizer would make them one that no scan takes
            found = self._parts_of(sub, child, own)
            plain += [(~child.present() | c, True) if filters else (F.coalesce(F.when(child.present(), c), F.lit(True)), False) for c, filters in found]
        for p, sub in s.get("patternProperties", {}).items():
            parts.append(self._every_key(v, matching(v.keys(), p), sub, at))
        extra = self._extra(s)
        if extra is False:
            parts.append(~is_object | (F.size(self._extra_keys(s, v)) == 0))
        elif isinstance(extra, dict):
            parts.append(self._every_key(v, self._extra_keys(s, v), extra, at))
        if "propertyNames" in s:
            parts.append(~is_object | F.coalesce(F.forall(v.keys(), lambda k: self._check(s["propertyNames"], Typed(k, T.StringType()), at)), F.lit(True)))
        parts += [F.coalesce(p, F.lit(True)) for p in self._item_checks(s, v, at)]
        for k, sub in s.get("dependentSchemas", {}).items():
            parts.append(~(is_object & v.get(k).present()) | self._check(sub, v, at))
        plain += [p for m in s.get("allOf", []) for p in self._parts_of(m, v, at)]
        if "anyOf" in s:
            plain.append((any_of([self._check(m, v, at) for m in s["anyOf"]]), True))
        if "oneOf" in s:
            parts.append(self._count(s["oneOf"], v, at) == 1)
        if "not" in s:
            parts.append(~self._check(s["not"], v, at))
        if "if" in s:
            chosen = self._check(s["if"], v, at)
            parts.append(F.when(chosen, self._check(s.get("then", True), v, at)).otherwise(self._check(s.get("else", True), v, at)))
        parts += [~t.fails for t in self._unevaluated(s, v, at)]
        if (target := s.get("rdfs:range")) is not None and (r := self._range(target, v, at)):
            parts.append(~is_object | self._check(r[0], v, r[1]))
        return plain + [(p, False) for p in parts]

    def _parts_of(self, s: Schema, v: Value, at: _At) -> list[tuple[Column, bool]]:
        """The conditions of a sub-schema: all in one where it is an evaluation of its own."""
        return self._parts(s, v, at)

    def _count(self, members: list, v: Value, at: _At) -> Column:
        return sum((self._check(m, v, at).cast("int") for m in members), F.lit(0))

    def _every_key(self, v: Value, keys: Column, sub: Schema, at: _At) -> Column:
        if isinstance(v, Typed) and isinstance(v.kind, T.StructType):
            return all_of([~F.coalesce(F.array_contains(keys, n), F.lit(False)) | self._check(sub, v.get(n), at) for n in v.kind.names])
        if isinstance(v, Typed) and not isinstance(v.kind, T.MapType):
            return F.lit(True)
        return F.coalesce(F.forall(keys, lambda k: self._check(sub, v.lookup(k), at)), F.lit(True))

    def _item_checks(self, s: dict, v: Value, at: _At) -> Iterator[Column]:
        if isinstance(v, Typed) and not isinstance(v.kind, T.ArrayType):
            return
        prefix = s.get("prefixItems", [])
        for i, sub in enumerate(prefix):
            yield ~v.is_type("array") | (F.size(v.items()) <= i) | self._check(sub, v.item(F.get(v.items(), i)), at)
        if "items" in s:
            rest = F.slice(v.items(), len(prefix) + 1, F.greatest(F.size(v.items()) - len(prefix), F.lit(0))) if prefix else v.items()
            yield ~v.is_type("array") | (F.size(rest) == 0 if s["items"] is False else F.forall(rest, lambda x: self._check(s["items"], v.item(x), at)))

    def _extra(self, s: dict) -> Schema | None:
        if self.ignore_additional:
            return None
        how = config(s).get("extra")
        if how == "forbid":
            return False
        return None if how in ("allow", "strip") else s.get("additionalProperties")

    def _range(self, target: Any, v: Value, at: _At) -> tuple[Schema, _At] | None:
        ref = target.get("$ref") if isinstance(target, dict) else target
        if not isinstance(ref, str) or not self.registry.has(ref.partition("#")[0] or at.root):
            return None
        return self._ref({"$ref": ref}, v, at)

    # evaluated keys, for unevaluatedProperties and unevaluatedItems

    def _evaluated(self, s: Schema, v: Value, at: _At) -> Column:
        none = F.array().cast(NO_STRINGS)
        if not isinstance(s, dict):
            return none
        if "additionalProperties" in s or "unevaluatedProperties" in s:
            return v.keys()
        out = F.array(*map(F.lit, s.get("properties", {}))).cast(NO_STRINGS)
        for p in s.get("patternProperties", {}):
            out = F.array_union(out, matching(v.keys(), p))
        for m, own, guard in self._in_place(s, v, at):
            keys = self._evaluated(m, v, own)
            out = F.array_union(out, keys if guard is None else F.when(guard, keys).otherwise(none))
        return out

    def _evaluated_items(self, s: Schema, v: Value, at: _At) -> Column:
        if not isinstance(s, dict):
            return F.lit(0)
        if "items" in s or "unevaluatedItems" in s:
            return F.size(v.items())
        out = F.lit(len(s.get("prefixItems", [])))
        for m, own, guard in self._in_place(s, v, at):
            n = self._evaluated_items(m, v, own)
            out = F.greatest(out, n if guard is None else F.when(guard, n).otherwise(0))
        return out

    def _in_place(self, s: dict, v: Value, at: _At) -> Iterator[tuple[Schema, _At, Column | None]]:
        """Sub-schemas that apply to the same value, with the condition under which they do."""
        if ref := self._ref(s, v, at):
            yield ref[0], ref[1], None
        for m in s.get("allOf", []):
            yield m, at, None
        for m in [*s.get("anyOf", []), *s.get("oneOf", [])]:
            yield m, at, self._check(m, v, at)
        if "if" in s:
            chosen = self._check(s["if"], v, at)
            yield s["if"], at, chosen
            yield s.get("then", True), at, chosen
            yield s.get("else", True), at, ~chosen
        for k, m in s.get("dependentSchemas", {}).items():
            yield m, at, v.get(k).present()

    def _unevaluated(self, s: dict, v: Value, at: _At) -> Iterator[Test]:
        if "unevaluatedProperties" in s and s["unevaluatedProperties"] is not True:
            plain = {k: x for k, x in s.items() if k != "unevaluatedProperties"}
            left = F.array_except(v.keys(), self._evaluated(plain, v, at))
            sub = s["unevaluatedProperties"]
            fails = F.size(left) > 0 if sub is False else ~self._every_key(v, left, sub, at)
            yield Test("unevaluatedProperties", F.coalesce(v.is_type("object") & fails, F.lit(False)), "must NOT have unevaluated properties", {})
        if "unevaluatedItems" in s and s["unevaluatedItems"] is not True and not (isinstance(v, Typed) and not isinstance(v.kind, T.ArrayType)):
            plain = {k: x for k, x in s.items() if k != "unevaluatedItems"}
            seen = self._evaluated_items(plain, v, at)
            rest = F.slice(v.items(), seen + 1, F.greatest(F.size(v.items()) - seen, F.lit(0)))
            held = lambda x: (self._check(s["contains"], v.item(x), at) if "contains" in s else F.lit(False)) | self._check(s["unevaluatedItems"], v.item(x), at)
            yield Test("unevaluatedItems", F.coalesce(v.is_type("array") & ~F.forall(rest, held), F.lit(False)), "must NOT have unevaluated items", {})

    # errors

    def _collect(self, tests: list[Test], path: Column) -> Column:
        if not tests:
            return no_errors()
        return F.array_compact(F.array(*(F.when(t.fails, one_error(path, t.keyword, t.message, t.params)) for t in tests)).cast(f"array<{ERROR}>"))

    def _errors(self, s: Schema, v: Value, path: Column, at: _At) -> Column:
        """The errors in the reference's order: reference, scalars, object or array structure, dependents, names, compositions."""
        if s is True:
            return no_errors()
        if s is False:
            return F.array(one_error(path, "falseSchema", "must not match false schema", {})).cast(f"array<{ERROR}>")
        parts: list[Column] = []
        add = lambda tests: parts.append(self._collect(tests, path)) if (tests := list(tests)) else None
        if ref := self._ref(s, v, at):
            parts.append(self._errors(ref[0], v, path, ref[1]))
        add(self._scalars(s, v, at))
        add(self._object_tests(s, v))
        add(self._array_tests(s, v, at))
        is_object = v.is_type("object")
        for _, sub, child, step, own in self._children(s, v, at):
            inner = self._errors(sub, child, F.concat(path, F.lit("/" + step)), own)
            parts.append(F.when(child.present(), inner).otherwise(no_errors()))
        for p, sub in s.get("patternProperties", {}).items():
            parts.append(self._key_errors(v, matching(v.keys(), p), sub, path, at))
        extra = self._extra(s)
        if extra is False:
            one = lambda k: one_error(F.concat(path, F.lit("/"), k), "additionalProperties", F.concat(F.lit("must NOT have additional property '"), k, F.lit("'")), {"additionalProperty": k})
            parts.append(F.when(is_object, F.transform(self._extra_keys(s, v), one)).otherwise(no_errors()))
        elif isinstance(extra, dict):
            parts.append(self._key_errors(v, self._extra_keys(s, v), extra, path, at))
        parts += self._item_errors(s, v, path, at)
        add(self._dependents(s, v))
        for k, sub in s.get("dependentSchemas", {}).items():
            parts.append(F.when(is_object & v.get(k).present(), self._errors(sub, v, path, at)).otherwise(no_errors()))
        if "propertyNames" in s:
            one = lambda k: self._errors(s["propertyNames"], Typed(k, T.StringType()), F.concat(path, F.lit("/"), k), at)
            parts.append(F.when(is_object, F.flatten(F.transform(v.keys(), one))).otherwise(no_errors()))
        parts += [self._errors(m, v, path, at) for m in s.get("allOf", [])]
        composed: list[Test] = []
        if "anyOf" in s:
            composed.append(Test("anyOf", ~any_of([self._check(m, v, at) for m in s["anyOf"]]), "must match at least one schema", {}))
        if "oneOf" in s:
            n = self._count(s["oneOf"], v, at)
            composed.append(Test("oneOf", n != 1, "must match exactly one schema", {"matchCount": n.cast("string")}))
        if "not" in s:
            composed.append(Test("not", self._check(s["not"], v, at), "must not match schema", {}))
        add(composed)
        if "if" in s:
            chosen = self._check(s["if"], v, at)
            parts.append(F.when(chosen, self._errors(s.get("then", True), v, path, at)).otherwise(self._errors(s.get("else", True), v, path, at)))
        add(self._unevaluated(s, v, at))
        if (target := s.get("rdfs:range")) is not None and (r := self._range(target, v, at)):
            parts.append(F.when(is_object, self._errors(r[0], v, path, r[1])).otherwise(no_errors()))
        parts = [p for p in parts if p is not None]
        return self._joined(parts) if len(parts) > 1 else parts[0] if parts else no_errors()

    def _joined(self, parts: list[Column]) -> Column:
        return F.concat(*parts)

    def _key_errors(self, v: Value, keys: Column, sub: Schema, path: Column, at: _At) -> Column:
        if isinstance(v, Typed) and isinstance(v.kind, T.StructType):
            made = [F.when(F.array_contains(keys, n), self._errors(sub, v.get(n), F.concat(path, F.lit("/" + n)), at)).otherwise(no_errors()) for n in v.kind.names]
            return F.concat(*made) if made else no_errors()
        if isinstance(v, Typed) and not isinstance(v.kind, T.MapType):
            return no_errors()
        return F.coalesce(F.flatten(F.transform(keys, lambda k: self._errors(sub, v.lookup(k), F.concat(path, F.lit("/"), k), at))), no_errors())

    def _item_errors(self, s: dict, v: Value, path: Column, at: _At) -> Iterator[Column]:
        if isinstance(v, Typed) and not isinstance(v.kind, T.ArrayType):
            return
        prefix = s.get("prefixItems", [])
        for i, sub in enumerate(prefix):
            inner = self._errors(sub, v.item(F.get(v.items(), i)), F.concat(path, F.lit(f"/{i}")), at)
            yield F.when(v.is_type("array") & (F.size(v.items()) > i), inner).otherwise(no_errors())
        if s.get("items") is False:
            over = v.is_type("array") & (F.size(v.items()) > len(prefix))
            yield self._collect([Test("items", F.coalesce(over, F.lit(False)), "must NOT have items beyond prefixItems", {})], path)
        elif isinstance(s.get("items"), dict):
            one = lambda x, i: F.when(i >= len(prefix), self._errors(s["items"], v.item(x), F.concat(path, F.lit("/"), i.cast("string")), at)).otherwise(no_errors())
            yield F.when(v.is_type("array"), F.coalesce(F.flatten(F.transform(v.items(), one)), no_errors())).otherwise(no_errors())


class _At(NamedTuple):
    """Where a sub-schema stands: its document, the references followed on the way, the documents on the way (outermost first), and how many schemas deep it is."""

    root: str
    seen: frozenset[str] = frozenset()
    scope: tuple[str, ...] = ()
    level: int = 0
