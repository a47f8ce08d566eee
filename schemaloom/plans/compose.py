"""Schema algebra: schemas from schemas, as plain dictionaries."""

from __future__ import annotations

from typing import Any

from .registry import ext


def _id(schema: dict | str) -> str:
    return schema if isinstance(schema, str) else schema["$id"]


def _config(schema: dict) -> dict:
    return {k: v for k, v in schema.items() if k.endswith(":config")}


def pick(schema: dict, keys: list[str], new_id: str) -> dict:
    """Only some own properties, with what of required names them."""
    out = {"$id": new_id, "type": "object", "properties": {k: v for k, v in schema.get("properties", {}).items() if k in keys}} | _config(schema)
    if needed := [k for k in schema.get("required", []) if k in keys]:
        out["required"] = needed
    return out


def omit(schema: dict, keys: list[str], new_id: str) -> dict:
    return pick(schema, [k for k in schema.get("properties", {}) if k not in keys], new_id)


def partial(schema: dict, new_id: str) -> dict:
    return {k: v for k, v in schema.items() if k != "required"} | {"$id": new_id}


def required(schema: dict, new_id: str) -> dict:
    return schema | {"$id": new_id, "required": list(schema.get("properties", {}))}


def extend(base: dict | str, additions: dict, new_id: str) -> dict:
    merged = _config(base) | _config(additions) if isinstance(base, dict) else _config(additions)
    return {"$id": new_id, "allOf": [{"$ref": _id(base)}, {k: v for k, v in additions.items() if k != "$id"}]} | merged


def intersection(schemas: list, new_id: str) -> dict:
    return {"$id": new_id, "allOf": [{"$ref": _id(s)} for s in schemas]}


def discriminated_union(schemas: list, discriminator: str, new_id: str) -> dict:
    return {"$id": new_id, "oneOf": [{"$ref": _id(s)} for s in schemas], "discriminator": {"propertyName": discriminator}}


def equivalent(schema: dict | str, new_id: str) -> dict:
    return {"$id": new_id, "$ref": _id(schema)}


def sub_class_of(parents: list, body: dict, new_id: str) -> dict:
    return {"$id": new_id, "allOf": [*({"$ref": _id(p)} for p in parents), {k: v for k, v in body.items() if k != "$id"}]}


def disjoint_with(schema: dict, other: dict | str) -> dict:
    return schema | {"disjointWith": _id(other)}


def complement_of(schema: dict | str, new_id: str) -> dict:
    return {"$id": new_id, "not": {"$ref": _id(schema)}}


def restriction(schema: dict, kind: str, on: str, value: Any, prefix: str = "ext") -> dict:
    """allValuesFrom, someValuesFrom, hasValue, cardinality, minCardinality or maxCardinality on a property."""
    key = f"{prefix}:restrictions"
    return schema | {key: [*schema.get(key, []), {"kind": kind, "property": on, "value": value}]}


def annotated_edge(predicate: str, target: str, annotations: dict, prefix: str = "ext") -> dict:
    return {f"{prefix}:annotatedEdge": {"predicate": predicate, "targetRef": target, "annotations": annotations}}


def defaults(schema: dict, registry=None) -> dict:
    """Declared defaults, those of allOf members first."""
    out: dict[str, Any] = {}
    for m in schema.get("allOf", []):
        target = registry[m["$ref"]] if registry is not None and "$ref" in m else m
        out |= defaults(target, registry)
    return out | {k: v["default"] for k, v in schema.get("properties", {}).items() if isinstance(v, dict) and "default" in v}


def narrow(schema: dict, registry, value: Any) -> dict | None:
    """The member of a discriminated union whose discriminator has a value."""
    name = schema["discriminator"]["propertyName"]
    for m in schema["oneOf"]:
        target = registry[m["$ref"]]
        d = registry.properties(target["$id"]).get(name, {})
        if d.get("const", (d.get("enum") or [None])[0]) == value:
            return target
    return None


def restrictions(schema: dict) -> list[dict]:
    return ext(schema, "restrictions") or []
