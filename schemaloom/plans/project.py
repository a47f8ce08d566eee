"""Value transformation: documents projected through a schema into typed structs.

One projection does the work of several verbs: ``convert`` coerces, ``cast`` also fills defaults, ``clean`` keeps only
declared keys as they are, ``create`` is the projection of nothing, ``materialize`` gives every declared key.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import text
from ..functions.numbers import number_text
from .compiler import _At
from .registry import Registry, Schema, config, ext
from .values import WHOLE, Typed, Value, Variant, hold

DEFAULT_DEPTH = 8


def number_of(v: Value) -> Column:
    """What JavaScript's Number() makes of strings and booleans; null where that is no number."""
    t = F.trim(v.text())
    hexadecimal = F.when(t.rlike(r"^0[xX][0-9A-Fa-f]{1,15}$"), F.conv(F.substring(t, 3, 20), 16, 10).cast("double"))
    from_text = F.when(t == "", F.lit(0.0)).when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double")).otherwise(hexadecimal)
    return F.coalesce(v.number(), from_text, F.when(v.is_type("boolean"), boolean_plain(v).cast("double")))


def whole_of(v: Value, coerce: bool) -> Column:
    """A number cut to its whole part; whole ones of 64 bits exactly, others by way of a double."""
    n = number_of(v) if coerce else v.number()
    cut = F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("bigint")
    if isinstance(v, Typed):
        if isinstance(v.kind, WHOLE):
            return v.col.cast("bigint")
        if isinstance(v.kind, T.DecimalType):
            return F.when(v.col >= 0, F.floor(v.col)).otherwise(F.ceil(v.col)).try_cast("bigint")
        exact = F.lit(None).cast("bigint")
    else:
        exact = F.when(v.schema == "BIGINT", F.try_variant_get(v.col, "$", "bigint"))
    if coerce:
        t = F.trim(v.text())
        exact = F.coalesce(exact, F.when(t.rlike(r"^[+-]?\d{1,19}$"), t.try_cast("bigint")))
    return F.coalesce(exact, cut)


def boolean_plain(v: Value) -> Column:
    if isinstance(v, Typed):
        return v.col if isinstance(v.kind, T.BooleanType) else F.lit(None).cast("boolean")
    return F.when(v.is_type("boolean"), F.try_variant_get(v.col, "$", "boolean"))


def boolean_of(v: Value) -> Column:
    t, n = v.text(), v.number()
    return F.coalesce(boolean_plain(v), F.when(t.isin("true", "1") | (n == 1), F.lit(True)).when(t.isin("false", "0") | (n == 0), F.lit(False)))


def string_of(v: Value) -> Column:
    n = v.number()
    return F.coalesce(v.text(), F.when(n.isNotNull(), number_text(n)), boolean_plain(v).cast("string"))


class Projector:
    """Coercion, defaults and shapes of the schemas of a registry."""

    def __init__(self, registry: Registry, coerce: bool = True, defaults: bool = True, decode: bool = True):
        self.registry, self.coerce, self.defaults, self.decode = registry, coerce, defaults, decode

    # shapes

    def struct_type(self, schema_id: str) -> T.DataType:
        """The Spark type of a schema: what compile-time inference is elsewhere."""
        key = self.registry.expand(schema_id)
        return self._type(self.registry[key], _At(key), 0)

    def _deref(self, s: Schema, at: _At) -> tuple[Schema, _At]:
        while isinstance(s, dict) and "$ref" in s and "properties" not in s:
            doc, s = self.registry.resolve(s["$ref"], at.root)
            at = _At(doc, at.seen)
        return s, at

    def properties(self, s: Schema, at: _At, depth: int = 0) -> dict[str, tuple[Schema, _At]]:
        """Own properties, then those of references, allOf, anyOf, oneOf, then and else; the first definition wins."""
        out: dict[str, tuple[Schema, _At]] = {}
        if not isinstance(s, dict) or depth > DEFAULT_DEPTH:
            return out
        for k, v in s.get("properties", {}).items():
            out.setdefault(k, (v, at))
        if "$ref" in s:
            doc, target = self.registry.resolve(s["$ref"], at.root)
            for k, v in self.properties(target, _At(doc), depth + 1).items():
                out.setdefault(k, v)
        for m in [*s.get("allOf", []), *s.get("anyOf", []), *s.get("oneOf", []), s.get("then"), s.get("else")]:
            for k, v in self.properties(m, at, depth + 1).items():
                out.setdefault(k, v)
        return out

    def kind(self, s: Schema, at: _At) -> str | None:
        s, at = self._deref(s, at)
        if not isinstance(s, dict):
            return None
        t = s.get("type")
        t = next((x for x in t if x != "null"), None) if isinstance(t, list) else t
        if t is None and self.properties(s, at):
            t = "object"
        if t is None and ("enum" in s or "const" in s):
            values = s.get("enum", [s.get("const")])
            t = "string" if all(isinstance(x, str) for x in values) else "boolean" if all(isinstance(x, bool) for x in values) else "number" if all(isinstance(x, (int, float)) for x in values) else None
        return t

    def branches(self, s: Schema, at: _At) -> list[tuple[Schema, Schema]]:
        """(condition, schema) of the ways in which a value without a type of its own may be read, in the order in which they are tried."""
        if not isinstance(s, dict) or self.kind(s, at) is not None:
            return []
        if "if" in s:
            return [(s["if"], s.get("then", True)), (True, s.get("else", True))]
        ways = [(m, m) for k in ("oneOf", "anyOf") for m in s.get(k, []) if isinstance(m, dict) and m.get("type") != "null"]
        return ways or [(True, m) for m in s.get("allOf", []) if isinstance(m, dict) and (self.kind(m, at) or self.branches(m, at))][:1]

    def _branch_type(self, s: Schema, at: _At, depth: int) -> T.DataType:
        """The type that all branches have, or else a variant."""
        kinds = [self._type(m, at, depth + 1) for _, m in self.branches(s, at)]
        return kinds[0] if kinds and all(k == kinds[0] for k in kinds) else T.VariantType()

    def _type(self, s: Schema, at: _At, depth: int) -> T.DataType:
        s, at = self._deref(s, at)
        kind = self.kind(s, at)
        if depth < DEFAULT_DEPTH and self.branches(s, at):
            return self._branch_type(s, at, depth)
        simple = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}
        if kind in simple:
            return simple[kind]
        if depth < DEFAULT_DEPTH and kind == "array":
            items = s.get("items") if isinstance(s.get("items"), dict) else (s.get("prefixItems") or [{}])[0]
            return T.ArrayType(self._type(items, at, depth + 1))
        if depth < DEFAULT_DEPTH and kind == "object" and (props := self.properties(s, at)):
            return T.StructType([T.StructField(k, self._type(v, own, depth + 1)) for k, (v, own) in props.items()])
        if depth < DEFAULT_DEPTH and kind == "object" and isinstance(s.get("additionalProperties"), dict):
            return T.MapType(T.StringType(), self._type(s["additionalProperties"], at, depth + 1))
        return T.VariantType()

    # values

    def project(self, schema_id: str, v: Value) -> Column:
        key = self.registry.expand(schema_id)
        return self._project(self.registry[key], v, _At(key), 0)

    def project_column(self, df: DataFrame, schema_id: str, column: str, name: str) -> DataFrame:
        """df with the projection of a VARIANT column. Its declared members are taken out first, each once."""
        key = self.registry.expand(schema_id)
        props = self.properties(self.registry[key], _At(key))
        keys = dict.fromkeys([*props, *(a for s, _ in props.values() if isinstance(a := ext(s, "alias"), str))])
        held, value = hold(df, column, list(keys))
        return held.withColumn(name, self.project(schema_id, value)).select(*df.columns, name)

    def default_of(self, s: Schema, at: _At, depth: int = 0) -> Any:
        """The explicit default, or that of a reference, or the object of nested defaults; None where there is none."""
        if not isinstance(s, dict) or depth > DEFAULT_DEPTH:
            return None
        if "default" in s:
            return s["default"]
        if "$ref" in s:
            doc, target = self.registry.resolve(s["$ref"], at.root)
            return self.default_of(target, _At(doc), depth + 1)
        nested = {k: d for k, v in s.get("properties", {}).items() if (d := self.default_of(v, at, depth + 1)) is not None}
        return nested or None

    def zero_of(self, s: Schema, at: _At, depth: int = 0) -> Any:
        """default, const, first of enum, reference, then the type's empty value; objects hold their required keys."""
        if not isinstance(s, dict) or depth > DEFAULT_DEPTH:
            return None
        for k in ("default", "const"):
            if k in s:
                return s[k]
        if s.get("enum"):
            return s["enum"][0]
        if "$ref" in s:
            doc, target = self.registry.resolve(s["$ref"], at.root)
            return self.zero_of(target, _At(doc), depth + 1)
        t = s.get("type")
        t = t[0] if isinstance(t, list) else t
        if t == "object" or t is None and "properties" in s:
            own = {k: self.zero_of(v, at, depth + 1) for k, v in s.get("properties", {}).items() if k in s.get("required", []) or self.default_of(v, at, depth + 1) is not None}
            for m in s.get("allOf", []):
                if isinstance(more := self.zero_of(m, at, depth + 1), dict):
                    own = more | own
            return own
        if t is not None:
            return {"string": "", "number": 0, "integer": 0, "boolean": False, "null": None, "array": []}[t]
        for m in s.get("allOf", []):
            if isinstance(made := self.zero_of(m, at, depth + 1), dict):
                return made
        return next((z for m in [*s.get("anyOf", []), *s.get("oneOf", [])] if (z := self.zero_of(m, at, depth + 1)) is not None), None)

    def _strict(self, s: Schema, at: _At) -> bool:
        """Whether a value is taken as it is even where others are coerced: by its own keyword, or else by its document's configuration."""
        own = ext(s, "strict")
        if own is None:
            own = config(self.registry[at.root]).get("strict") if self.registry.has(at.root) else False
        return bool(own)

    def encode(self, schema_id: str, v: Value) -> Column:
        """A decoded value in its wire form: each registered encoder undoes its decoder, at the root, in objects and in arrays."""
        key = self.registry.expand(schema_id)
        out = self._encode(self.registry[key], v, _At(key))
        encoder = self.registry.transforms.get(key, (None, None))[1]
        return encoder(out) if encoder else out

    def _encode(self, s: Schema, v: Value, at: _At) -> Column:
        s0 = s
        s, at = self._deref(s, at)
        encoder = self.registry.transforms.get(at.root, (None, None))[1] if s is not s0 else None
        if encoder:
            return encoder(v.col)
        if isinstance(v, Typed) and isinstance(v.kind, T.StructType) and (props := self.properties(s, at)):
            fields = [(self._encode(props[f.name][0], v.get(f.name), props[f.name][1]) if f.name in props else v.col[f.name]).alias(f.name) for f in v.kind]
            return F.when(v.col.isNotNull(), F.struct(*fields))
        if isinstance(v, Typed) and isinstance(v.kind, T.ArrayType) and isinstance(s, dict) and isinstance(s.get("items"), dict):
            return F.transform(v.col, lambda x: self._encode(s["items"], v.item(x), at))
        return v.col

    def dump_json(self, schema_id: str, v: Typed, include: list[str] = (), exclude: list[str] = (), exclude_defaults: bool = False, given: Value | None = None) -> Column:
        """JSON text of a value in its wire form; dates as ISO texts, unset fields left out.

        ``given`` is the document that the value was made of: then fields that it doesn't have (filled in by defaults, or
        computed) go, at each level of objects.

        The filters hold at each level, as do encoders; what is included beats what is excluded, and a field that equals
        its explicit default goes where that is asked for.
        """
        key = self.registry.expand(schema_id)
        shaped = self._dumped(self.registry[key], v, _At(key), tuple(include), tuple(exclude), exclude_defaults, given)
        encoder = self.registry.transforms.get(key, (None, None))[1]
        return F.to_json(encoder(shaped) if encoder else shaped, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"})

    def _dumped(self, s: Schema, v: Typed, at: _At, include: tuple, exclude: tuple, exclude_defaults: bool, given: Value | None = None) -> Column:
        s0 = s
        s, at = self._deref(s, at)
        encoder = self.registry.transforms.get(at.root, (None, None))[1] if s is not s0 else None
        if encoder:
            return encoder(v.col)
        if isinstance(v.kind, T.StructType) and (props := self.properties(s, at)):
            fields = []
            for f in v.kind:
                if f.name not in include if include else f.name in exclude:
                    continue
                child = v.get(f.name)
                sub, own = props.get(f.name, ({}, at))
                was = given.get(f.name) if given is not None else None
                col = self._dumped(sub, child, own, include, exclude, exclude_defaults, was)
                if was is not None:
                    alias = ext(sub, "alias")
                    col = F.when(was.present() | given.get(alias).present() if isinstance(alias, str) else was.present(), col)
                if exclude_defaults and isinstance(sub, dict) and "default" in sub and not isinstance(sub["default"], (dict, list)):
                    col = F.when(~F.coalesce(child.canonical() == text(sub["default"]), F.lit(False)), col)
                fields.append(col.alias(f.name))
            return F.when(v.col.isNotNull(), F.struct(*fields)) if fields else F.when(v.col.isNotNull(), F.create_map().cast("map<string,string>"))
        if isinstance(v.kind, T.ArrayType) and isinstance(s, dict) and isinstance(s.get("items"), dict):
            return F.transform(v.col, lambda x: self._dumped(s["items"], v.item(x), at, include, exclude, exclude_defaults))
        return v.col

    def create(self, schema_id: str) -> Column:
        """A default instance as a typed literal."""
        key = self.registry.expand(schema_id)
        made = F.parse_json(F.lit(text(self.zero_of(self.registry[key], _At(key)), sort=False)))
        return Projector(self.registry, coerce=False, defaults=True).project(key, Variant(made))

    def _project(self, s: Schema, v: Value, at: _At, depth: int) -> Column:
        s0, at0 = s, at
        s, at = self._deref(s, at)
        kind = self.kind(s, at)
        decode = self.registry.transforms.get(at.root, (None, None))[0] if s is not s0 and self.decode else None
        target = self._type(s0, at0, depth)
        coerce = self.coerce and not self._strict(s0, at0)
        if kind == "string":
            out = string_of(v) if coerce else v.text()
        elif kind == "number":
            out = number_of(v) if coerce else v.number()
        elif kind == "integer":
            out = whole_of(v, coerce)
        elif kind == "boolean":
            out = boolean_of(v) if coerce else boolean_plain(v)
        elif isinstance(target, T.ArrayType):
            items = s.get("items") if isinstance(s.get("items"), dict) else (s.get("prefixItems") or [{}])[0]
            # items at the front that have schemas of their own, of the same type, are read by these
            front = [m for m in s.get("prefixItems", []) if self._type(m, at, depth + 1) == target.elementType]

            def one(x: Column, i: Column) -> Column:
                out = self._project(items, v.item(x), at, depth + 1)
                for n, m in enumerate(front if len(front) == len(s.get("prefixItems", [])) else []):
                    out = F.when(i == n, self._project(m, v.item(x), at, depth + 1)).otherwise(out)
                return out

            many = F.transform(v.items(), one) if not isinstance(v, Typed) or isinstance(v.kind, T.ArrayType) else F.lit(None).cast(target)
            if coerce and not (isinstance(v, Typed) and isinstance(v.kind, T.ArrayType)):
                scalar = v.present() & ~v.is_type("array") & ~v.is_type("null") & ~v.is_type("object")
                many = F.when(scalar, F.array(self._project(items, v, at, depth + 1))).otherwise(many)
            out = many
        elif ways := self.branches(s, at):
            out = self._branch(ways, v, at, target, depth)
        elif isinstance(target, T.MapType):
            held = v.col if isinstance(v, Typed) else F.try_variant_get(v.col, "$", "map<string,variant>")
            of = lambda x: Typed(x, v.kind.valueType) if isinstance(v, Typed) else Variant(x)
            out = F.transform_values(held, lambda _, x: self._project(s["additionalProperties"], of(x), at, depth + 1)) if not isinstance(v, Typed) or isinstance(v.kind, T.MapType) else F.lit(None).cast(target)
        elif isinstance(target, T.StructType):
            fields = []
            for k, (sub, own) in self.properties(s, at).items():
                child = v.get(k)
                alias = ext(sub, "alias")
                col = self._project(sub, child, own, depth + 1)
                if isinstance(alias, str):
                    col = F.when(child.present(), col).otherwise(self._project(sub, v.get(alias), own, depth + 1))
                fields.append(col.alias(k))
            out = F.when(v.is_type("object"), F.struct(*fields))
        else:
            out = v.col if isinstance(v, Variant) else F.parse_json(F.coalesce(v.canonical(), F.lit("null")))
        out = out.cast(target) if not isinstance(target, (T.VariantType, T.StructType, T.ArrayType, T.MapType)) else out
        if self.defaults and (d := self.default_of(s0, at0)) is not None:
            filled = Projector(self.registry, coerce=False, defaults=False)._project(s0, Variant(F.parse_json(F.lit(text(d, sort=False)))), at0, depth)
            out = F.when(v.present(), out).otherwise(filled)
        return decode(out) if decode else out


    def _branch(self, ways: list[tuple[Schema, Schema]], v: Value, at: _At, target: T.DataType, depth: int) -> Column:
        """The value as the first branch reads it whose condition it meets, decoded as that branch says; null where it meets none."""
        from .compiler import Compiler

        checker, out = Compiler(self.registry), F.lit(None)
        for condition, m in reversed(ways):
            made = self._project(m, v, at, depth + 1) if isinstance(m, dict) else v.col
            if isinstance(target, T.VariantType) and isinstance(m, dict):
                made = self._as_variant(made, self._type(m, at, depth + 1))
            fits = v.present() if condition is True else v.present() & checker._check(condition, v, at)
            out = F.when(fits, made).otherwise(out)
        return out

    def _as_variant(self, c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.VariantType):
            return c
        return F.to_variant_object(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else F.parse_json(F.get(F.split(F.to_json(F.struct(c.alias("v"))), r'^\{"v":|\}$'), 1))


# differences and dumps


def diff(a: Value, b: Value, path: Column | None = None) -> Column:
    """array<struct<op, path, value>>: what makes a into b; keys of a first, then new keys of b. Values are JSON texts."""
    path = F.lit("") if path is None else path
    change = "array<struct<op:string,path:string,value:string>>"
    if isinstance(a, Typed) and isinstance(a.kind, T.StructType) and isinstance(b, Typed) and isinstance(b.kind, T.StructType):
        names = [*a.kind.names, *(n for n in b.kind.names if n not in a.kind.names)]
        parts = [diff(a.get(n), b.get(n), F.concat(path, F.lit("/" + n))) for n in names]
        return F.concat(*parts) if parts else F.array().cast(change)
    if isinstance(a, Typed) and isinstance(a.kind, T.ArrayType) and isinstance(b, Typed) and isinstance(b.kind, T.ArrayType):
        n = F.greatest(F.size(F.coalesce(a.col, F.array().cast(a.kind))), F.size(F.coalesce(b.col, F.array().cast(b.kind))))
        one = lambda i: diff(a.item(F.get(a.col, i.cast("int"))), b.item(F.get(b.col, i.cast("int"))), F.concat(path, F.lit("/"), i.cast("string")))
        return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), one))).otherwise(F.array().cast(change))
    left, right = F.when(a.present(), a.canonical()), F.when(b.present(), b.canonical())
    made = F.struct(F.when(b.present(), "set").otherwise("delete").alias("op"), path.alias("path"), right.alias("value"))
    return F.when(left.eqNullSafe(right), F.array().cast(change)).otherwise(F.array(made).cast(change))


def apply_changes(document: Column, changes: Column) -> Column:
    """JSON text with changes applied in order: set and delete by path; deleting from an array closes the gap. A vectorised function, as a change may go anywhere."""
    import json

    def patch(doc: str | None, ops) -> str | None:
        if doc is None:
            return None
        root = json.loads(doc)
        for op in ops if ops is not None else ():
            parts = op["path"].split("/")[1:]
            if not parts:
                root = json.loads(op["value"]) if op["op"] == "set" else None
                continue
            if any(p in ("__proto__", "constructor", "prototype") for p in parts):
                continue
            at = root
            for here, following in zip(parts, parts[1:]):
                if isinstance(at, list):
                    at = at[int(here)]
                else:
                    at = at.setdefault(here, [] if following.isdigit() else {})
            last = parts[-1]
            if op["op"] == "delete":
                if isinstance(at, list):
                    del at[int(last) : int(last) + 1]
                else:
                    at.pop(last, None)
            elif isinstance(at, list):
                at[int(last) : int(last) + 1] = [json.loads(op["value"])]
            else:
                at[last] = json.loads(op["value"])
        return json.dumps(root, separators=(",", ":"), ensure_ascii=False)

    return F.pandas_udf(lambda d, c: d.combine(c, patch), "string")(document, changes)


def merged(a: Value, b: Value) -> Column:
    """The members of two objects, those of the second over those of the first; what the second lacks stays. Not deep."""
    if isinstance(a, Typed) and isinstance(b, Typed):
        names = [*a.kind.names, *(n for n in b.kind.names if n not in a.kind.names)]
        return F.struct(*(F.coalesce(*(x.col[n] for x in (b, a) if n in x.kind.names)).alias(n) for n in names))
    first, second = (F.coalesce(F.try_variant_get(x.col, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")) for x in (a, b))
    return F.to_variant_object(F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second))


def dump(v: Typed, include: list[str] | None = None, exclude: list[str] = (), exclude_defaults: dict[str, Any] | None = None) -> Column:
    """JSON text of chosen fields; unset ones are left out, and so are those equal to their default where defaults are given. Include beats exclude."""
    fields = []
    for f in v.kind:
        if include is not None and f.name not in include or include is None and f.name in exclude:
            continue
        col = v.col[f.name]
        if exclude_defaults and f.name in exclude_defaults:
            col = F.when(~F.coalesce(v.get(f.name).canonical() == text(exclude_defaults[f.name]), F.lit(False)), col)
        fields.append(col.alias(f.name))
    return F.to_json(F.struct(*fields)) if fields else F.lit("{}")


def access_path(pointer: str) -> str:
    """A JSON pointer as accessor text: a.b[0]["x y"]."""
    import re

    out = ""
    for part in pointer.split("/")[1:]:
        if part.isdigit():
            out += f"[{part}]"
        elif re.fullmatch(r"[A-Za-z_$][\w$]*", part):
            out += f".{part}" if out else part
        else:
            out += f'["{part}"]'
    return out
