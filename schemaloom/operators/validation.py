"""Validation of DataFrames: filters, error columns, error relations and their summaries.

All but the summaries are narrow maps. In a DataFrame of flat columns a null counts as an absent key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import strict_json
from ..plans.compiler import Compiler, _At
from ..plans.project import Projector
from ..plans.values import Typed, Value, Variant, hold, value_of


def row_value(df: DataFrame, column: str | None = None) -> Value:
    """A column as a document, or the whole row as one."""
    if column is not None:
        return value_of(F.col(column), df.schema[column].dataType)
    return Typed(F.struct(*(F.col(f"`{c}`") for c in df.columns)), T.StructType(df.schema.fields))


def compiled(df: DataFrame, compiler: Compiler, what: str, schema_id: str, value: Value | None = None) -> Column:
    """``check`` or ``errors`` of a value, or of the whole row; rows of a type that was met before are compiled already."""
    if value is not None:
        return compiler.check(schema_id, value) if what == "check" else compiler.errors(schema_id, value)
    return compiler.kept(what, schema_id, row_value(df), df.schema)


def json_value(column: str) -> Value:
    """JSON text as a document; text that isn't JSON is an absent document."""
    return Variant(strict_json(F.col(column)))


def is_valid(df: DataFrame, compiler: Compiler, schema_id: str, value: Value | None = None) -> DataFrame:
    """The rows that satisfy a schema; plain comparisons reach the scan."""
    return df.where(compiled(df, compiler, "check", schema_id, value))


def with_errors(df: DataFrame, compiler: Compiler, schema_id: str, value: Value | None = None, name: str = "errors") -> DataFrame:
    return df.withColumn(name, compiled(df, compiler, "errors", schema_id, value))


def error_rows(df: DataFrame, compiler: Compiler, schema_id: str, keys: list[str], value: Value | None = None) -> DataFrame:
    """One row per error: the key columns, ord, path, keyword, message, params."""
    found = df.select(*keys, F.posexplode(compiled(df, compiler, "errors", schema_id, value)).alias("ord", "error"))
    return found.select(*keys, "ord", "error.*")


def aggregate(errors: Column) -> Column:
    """count, sorted distinct keywords, sorted distinct accessor paths of one document's errors."""
    paths = F.transform(errors, lambda e: accessor(e["path"]))
    return F.struct(F.size(errors).alias("count"), F.array_sort(F.array_distinct(F.transform(errors, lambda e: e["keyword"]))).alias("keywords"), F.array_sort(F.array_distinct(paths)).alias("paths"))


def accessor(path: Column) -> Column:
    """A JSON pointer as accessor text."""
    step = lambda out, p: F.when(p.rlike(r"^\d+$"), F.concat(out, F.lit("["), p, F.lit("]"))).when(p.rlike(r"^[A-Za-z_$][\w$]*$"), F.concat(out, F.when(out == "", "").otherwise("."), p)).otherwise(F.concat(out, F.lit('["'), p, F.lit('"]')))
    parts = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.aggregate(parts, F.lit(""), step)


def summary(errors: DataFrame, *by: str) -> DataFrame:
    """Errors of a whole relation by keyword and path: partial sums are made map-side."""
    return errors.groupBy(*(by or ("keyword", "path"))).agg(F.count(F.lit(1)).alias("n_errors"))


def problem_report(errors: Column, instance: Column, title: str = "Validation failed") -> Column:
    """Problem details (RFC 7807) as JSON text; null where there is no error."""
    told = F.transform(errors, lambda e: F.struct(e["path"].alias("path"), e["keyword"].alias("keyword"), e["message"].alias("message")))
    body = F.struct(F.lit("about:blank").alias("type"), F.lit(title).alias("title"), F.lit(422).alias("status"), F.concat(F.size(errors).cast("string"), F.lit(" validation error(s)")).alias("detail"), instance.alias("instance"), told.alias("errors"))
    return F.when(F.size(errors) > 0, F.to_json(body))


def quarantine(df: DataFrame, compiler: Compiler, schema_id: str, value: Value | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with their errors)."""
    checked = with_errors(df, compiler, schema_id, value)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def instantiate(df: DataFrame, compiler: Compiler, schema_id: str, column: str, cast: bool = False, policy: str = "quarantine") -> DataFrame:
    """df with ``instance`` (typed struct: defaults, declared keys only, computed fields) and ``errors``.

    Policy "quarantine" leaves the instance null where there are errors; "failfast" raises for such a row.
    """
    registry = compiler.registry
    key = registry.expand(schema_id)
    projector = Projector(registry, coerce=cast, defaults=True)
    columns, raw = df.columns, row_value(df, column)
    if isinstance(raw, Variant):
        df, raw = hold(df, column, list(projector.properties(registry[key], _At(key))))
    made = projector.project(schema_id, raw)
    kind = projector.struct_type(schema_id)
    df = df.withColumn("_made", made)  # made once; the checks below only read it
    made = F.col("_made")
    computed = registry.computed.get(key, {})
    errors = compiler.errors(schema_id, Typed(made, kind)) if cast else _without_defaults_missing(compiler, schema_id, raw, registry[key])
    given = [name for name in computed if not isinstance(raw, Typed)]
    if given:
        from ..plans.compiler import one_error

        errors = F.concat(errors, F.array_compact(F.array(*(F.when(raw.get(n).present(), one_error(F.lit("/" + n), "computed", f"computed field '{n}' must not be supplied", {"property": n})) for n in given))))
    if computed:
        made = F.struct(*(made[n].alias(n) for n in kind.names if n not in computed), *(f(Typed(made, kind)).alias(n) for n, f in computed.items()))
    out = df.withColumn("errors", errors)
    if policy == "failfast":
        return out.withColumn("instance", F.when(F.size("errors") == 0, made).otherwise(F.raise_error(F.to_json("errors")).cast(kind) if not computed else F.raise_error(F.to_json("errors")))).select(*columns, "errors", "instance")
    return out.withColumn("instance", F.when(F.size("errors") == 0, made)).select(*columns, "errors", "instance")


def materialize(df: DataFrame, compiler: Compiler, schema_id: str, column: str, partial: bool = False) -> DataFrame:
    """df with ``instance``: every declared key is there, null where it has neither a value nor a default; nothing is coerced or decoded.

    An invalid document is an error. Where it may be partial, none is: required keys that are missing get their type's
    empty value at the top level.
    """
    registry = compiler.registry
    if not partial:
        plain = Compiler(_without_transforms(registry), compiler.formats, compiler.max_depth, compiler.assert_formats, compiler.ignore_additional)
        return instantiate(df, plain, schema_id, column, policy="failfast").drop("errors")
    projector = Projector(registry, coerce=False, defaults=True, decode=False)
    kind = projector.struct_type(schema_id)
    made, empty = projector.project(schema_id, row_value(df, column)), projector.create(schema_id)
    schema = registry[registry.expand(schema_id)]
    filled = [(F.coalesce(made[n], empty[n]) if n in schema.get("required", []) else made[n]).alias(n) for n in kind.names]
    return df.withColumn("instance", F.struct(*filled))


def _without_transforms(registry):
    import copy

    out = copy.copy(registry)
    out.transforms = {}
    return out


def _without_defaults_missing(compiler: Compiler, schema_id: str, raw: Value, schema: dict) -> Column:
    """Errors of the document as it would be with its defaults: a missing key that has a default isn't missing."""
    projector = Projector(compiler.registry)
    from ..plans.compiler import _At

    at = _At(compiler.registry.expand(schema_id))
    filled = [k for k, (s, own) in projector.properties(schema, at).items() if projector.default_of(s, own) is not None]
    errors = compiler.errors(schema_id, raw)
    if not filled:
        return errors
    return F.filter(errors, lambda e: ~((e["keyword"] == "required") & (e["path"] == "") & F.element_at(e["params"], "missingProperty").isin(filled)))
