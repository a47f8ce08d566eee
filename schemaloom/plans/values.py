"""A document value as Columns: typed (structs, arrays, maps, scalars) or VARIANT.

Typed columns can't tell an absent key from a null one, so a null field of a struct counts as absent. In VARIANT
columns a missing key is SQL null and a JSON null is a value of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import number_text
from ..functions.rounds import let

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


class Value:
    """What the compiler asks of a value. All boolean Columns are never null."""

    col: Column

    def present(self) -> Column:
        return self.col.isNotNull()

    def is_type(self, name: str) -> Column:
        raise NotImplementedError

    def number(self) -> Column:
        raise NotImplementedError

    def text(self) -> Column:
        raise NotImplementedError

    def keys(self) -> Column:
        raise NotImplementedError

    def get(self, key: str) -> Value:
        raise NotImplementedError

    def lookup(self, key: Column) -> Value:
        raise NotImplementedError

    def items(self) -> Column:
        raise NotImplementedError

    def item(self, col: Column) -> Value:
        raise NotImplementedError

    def canonical(self) -> Column:
        """JSON text with sorted keys, equal for equal values."""
        raise NotImplementedError


class Typed(Value):
    def __init__(self, col: Column, kind: T.DataType):
        self.col, self.kind = col, kind

    def is_type(self, name: str) -> Column:
        k = self.kind
        if name == "null" or isinstance(k, T.NullType):
            return self.col.isNull() if name == "null" else F.lit(False)
        if name == "number" and isinstance(k, NUMERIC) or name == "integer" and isinstance(k, WHOLE):
            if isinstance(k, (T.FloatType, T.DoubleType)):
                return self.col.isNotNull() & (self.col > float("-inf")) & (self.col < float("inf"))  # not a number is above all
            return self.col.isNotNull()
        if name == "integer" and isinstance(k, NUMERIC):
            whole = self.col == F.floor(self.col) if isinstance(k, T.DecimalType) else self.col == F.rint(self.col)
            return F.coalesce(whole & (F.abs(self.col) < float("inf")), F.lit(False))
        fits = {"string": (T.StringType, *TEMPORAL), "boolean": T.BooleanType, "array": T.ArrayType, "object": (T.StructType, T.MapType)}.get(name)
        return self.col.isNotNull() if fits and isinstance(k, fits) else F.lit(False)

    def number(self) -> Column:
        return self.col.cast("double") if isinstance(self.kind, NUMERIC) else F.lit(None).cast("double")

    def text(self) -> Column:
        if isinstance(self.kind, T.DateType):
            return F.date_format(self.col, "yyyy-MM-dd")
        if isinstance(self.kind, TEMPORAL):
            return F.date_format(self.col, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return self.col if isinstance(self.kind, T.StringType) else F.lit(None).cast("string")

    def keys(self) -> Column:
        if isinstance(self.kind, T.StructType):
            return F.array_compact(F.array(*(F.when(self.col[f.name].isNotNull(), F.lit(f.name)) for f in self.kind)).cast("array<string>"))
        if isinstance(self.kind, T.MapType):
            return F.map_keys(self.col)
        return F.array().cast("array<string>")

    def get(self, key: str) -> Value:
        if isinstance(self.kind, T.StructType):
            return Typed(self.col[key], self.kind[key].dataType) if key in self.kind.names else Typed(F.lit(None), T.NullType())
        if isinstance(self.kind, T.MapType):
            return Typed(F.try_element_at(self.col, F.lit(key)), self.kind.valueType)
        return Typed(F.lit(None), T.NullType())

    def lookup(self, key: Column) -> Value:
        if isinstance(self.kind, T.MapType):
            return Typed(F.try_element_at(self.col, key), self.kind.valueType)
        raise TypeError("keys of a struct are known; a dynamic key needs a map or a variant")

    def items(self) -> Column:
        return self.col

    def item(self, col: Column) -> Value:
        return Typed(col, self.kind.elementType if isinstance(self.kind, T.ArrayType) else T.NullType())

    def canonical(self) -> Column:
        if isinstance(self.kind, NUMERIC):
            return number_text(F.try_add(self.number(), F.lit(0.0)))
        if isinstance(self.kind, T.BooleanType):
            return self.col.cast("string")
        if isinstance(self.kind, (T.StringType, *TEMPORAL)):
            return F.concat(F.lit('"'), F.regexp_replace(self.text(), r'(["\\])', r"\\$1"), F.lit('"'))
        if isinstance(self.kind, T.NullType):
            return F.lit("null")
        if isinstance(self.kind, T.StructType):
            parts = [F.when(self.col[n].isNotNull(), F.concat(F.lit(f'"{n}":'), self.get(n).canonical())) for n in sorted(self.kind.names)]
            return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))
        if isinstance(self.kind, T.ArrayType):
            return F.concat(F.lit("["), F.array_join(F.transform(self.col, lambda x: F.coalesce(self.item(x).canonical(), F.lit("null"))), ","), F.lit("]"))
        if isinstance(self.kind, T.MapType):
            sub = lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.coalesce(self.lookup(k).canonical(), F.lit("null")))
            return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(self.col)), sub), ","), F.lit("}"))
        return F.to_json(self.col)


class Variant(Value):
    """A VARIANT column. Numbers are compared as doubles, as exact decimals would differ from JSON numbers elsewhere."""

    def __init__(self, col: Column):
        self.col = col
        self.schema = F.schema_of_variant(col)

    def is_type(self, name: str) -> Column:
        if name == "object":  # the schema of a container takes a walk through all that it holds
            return self._as("map<string,variant>").isNotNull()
        if name == "array":
            return self._as("array<variant>").isNotNull()
        s = self.schema
        if name == "number":
            fits = s.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        elif name == "integer":
            d = self.number()
            fits = s.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (d == F.rint(d)) & (F.abs(d) < float("inf"))
        else:
            fits = s.startswith({"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[name])
        return F.coalesce(fits, F.lit(False))

    def _as(self, kind: str) -> Column:
        return F.try_variant_get(self.col, "$", kind)

    def number(self) -> Column:
        return F.when(self.schema.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), self._as("double"))

    def text(self) -> Column:
        return F.when(self.schema == "STRING", self._as("string"))

    def keys(self) -> Column:
        return F.map_keys(self._as("map<string,variant>"))

    def get(self, key: str) -> Value:
        quoted = f"$['{key}']" if "'" not in key else f'$["{key}"]'
        return Variant(F.try_variant_get(self.col, quoted, "variant"))

    def lookup(self, key: Column) -> Value:
        return Variant(F.try_element_at(self._as("map<string,variant>"), key))

    def items(self) -> Column:
        return self._as("array<variant>")

    def item(self, col: Column) -> Value:
        return Variant(col)

    def canonical(self) -> Column:
        d = self.number()
        return F.when(d.isNotNull(), number_text(d)).otherwise(F.to_json(self.col))


class Placed(Variant):
    """A variant that knows its path from the document's root."""

    def __init__(self, col: Column, path: Column):
        super().__init__(col)
        self.path = path

    def get(self, key: str) -> Value:
        return Placed(super().get(key).col, F.concat(self.path, F.lit("/" + key)))

    def lookup(self, key: Column) -> Value:
        return Placed(super().lookup(key).col, F.concat(self.path, F.lit("/"), key))

    def items(self) -> Column:
        return F.transform(super().items(), lambda x, i: F.struct(x.alias("value"), F.concat(self.path, F.lit("/"), i.cast("string")).alias("path")))

    def item(self, col: Column) -> Value:
        return Placed(col["value"], col["path"])


class Opened(Placed):
    """A placed variant whose members, if it is an object, are a column already: each look at one is a look into a map, which neither
    decodes the object again nor, for an absent member, costs the exception that Spark makes of a path that leads nowhere."""

    def __init__(self, col: Column, path: Column, members: Column):
        super().__init__(col, path)
        self.members = members
        self.schema = F.when(members.isNotNull(), "OBJECT").otherwise(self.schema)

    def is_type(self, name: str) -> Column:
        return self.members.isNotNull() if name == "object" else super().is_type(name)

    def keys(self) -> Column:
        return F.map_keys(self.members)

    def get(self, key: str) -> Value:
        return Placed(F.try_element_at(self.members, F.lit(key)), F.concat(self.path, F.lit("/" + key)))

    def lookup(self, key: Column) -> Value:
        return Placed(F.try_element_at(self.members, key), F.concat(self.path, F.lit("/"), key))


class Known(Placed):
    """A placed variant with its kind and number in a struct that was made once."""

    def __init__(self, held: Column, path: Column):
        super().__init__(held["value"], path)
        self.schema, self._number = held["kind"], held["number"]

    @staticmethod
    def held(v: Variant, f: Callable[[Column], Column]) -> Column:
        """f of the struct, whose number is null for what is none."""
        numeric = lambda kind: kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        made = lambda kind: F.struct(v.col.alias("value"), kind.alias("kind"), F.when(numeric(kind), v._as("double")).alias("number"))
        return let(v.schema, lambda kind: let(made(kind), f))

    def is_type(self, name: str) -> Column:
        if name not in ("number", "integer"):
            return super().is_type(name)
        n = self._number
        return n.isNotNull() if name == "number" else F.coalesce((n == F.rint(n)) & (F.abs(n) < float("inf")), F.lit(False))

    def number(self) -> Column:
        return self._number


class Held(Variant):
    """A variant whose kind, text and number are columns already."""

    def __init__(self, name: str):
        super().__init__(F.col(name))
        self.schema, self._text, self._number = (F.col(f"{name}_{x}") for x in ("kind", "text", "number"))

    def text(self) -> Column:
        return self._text

    def number(self) -> Column:
        return self._number


class Members(Variant):
    """An object of which some members are held."""

    def __init__(self, col: Column, is_object: Column, members: dict[str, Held]):
        super().__init__(col)
        self.is_object, self.members = is_object, members

    def is_type(self, name: str) -> Column:
        return self.is_object if name == "object" else super().is_type(name)

    def get(self, key: str) -> Value:
        return self.members.get(key) or super().get(key)


def hold(df: DataFrame, column: str, keys: list[str]) -> tuple[DataFrame, Members]:
    """df with helper columns for members of a variant, and the variant as a value that reads them.

    Coercion asks for a member's kind, text and number again and again; so each is taken out of the variant once.
    """
    names = {k: f"_member{i}" for i, k in enumerate(keys)}
    whole = Variant(F.col(column))
    df = df.withColumns({n: whole.get(k).col for k, n in names.items()} | {"_is_object": whole.is_type("object")})
    df = df.withColumns({f"{n}_kind": F.schema_of_variant(F.col(n)) for n in names.values()})
    kind = lambda n: F.col(f"{n}_kind")
    text = {f"{n}_text": F.when(kind(n) == "STRING", F.try_variant_get(F.col(n), "$", "string")) for n in names.values()}
    number = {f"{n}_number": F.when(kind(n).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(F.col(n), "$", "double")) for n in names.values()}
    return df.withColumns(text | number), Members(F.col(column), F.col("_is_object"), {k: Held(n) for k, n in names.items()})


def value_of(col: Column, kind: T.DataType) -> Value:
    return Variant(col) if isinstance(kind, T.VariantType) else Typed(col, kind)


def each_item(v: Value, f: Callable[[Value, Column], Column]) -> Column:
    """transform over an array value; null where it is none."""
    return F.transform(v.items(), lambda x, i: f(v.item(x), i))
