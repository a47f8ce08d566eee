"""A registry as a graph for viewing: nodes, edges, and a page that shows them."""

from __future__ import annotations

import html
import json

from ..plans.registry import Registry, subschemas


def payload(registry: Registry) -> dict:
    """nodes (id, title, property count), edges (source, target, kind) and the schemas."""
    nodes = [{"id": k, "title": s.get("title", k.rpartition("/")[2]), "propertyCount": len(registry.properties(k)) if not registry.unresolved() else len(s.get("properties", {}))} for k, s in registry.entries()]
    edges = []
    for k, s in registry.entries():
        for pointer, sub in subschemas(s):
            if isinstance(sub, dict) and isinstance(sub.get("$ref"), str) and not sub["$ref"].startswith("#"):
                edges.append({"source": k, "target": registry.expand(sub["$ref"].partition("#")[0]), "kind": "subClassOf" if pointer.startswith("/allOf/") else "property" if "/properties/" in pointer else "reference"})
    return {"nodes": nodes, "edges": edges, "schemas": dict(registry.entries())}


def edges(registry: Registry, spark):
    rows = [(e["source"], e["target"], e["kind"]) for e in payload(registry)["edges"]]
    return spark.createDataFrame(rows, "source string, target string, kind string")


def type_string(schema, depth: int = 0) -> str:
    """A schema as a compact type expression."""
    if not isinstance(schema, dict):
        return "unknown" if schema else "never"
    if "$ref" in schema:
        return schema["$ref"].rpartition("/")[2].rpartition("#")[2]
    if "enum" in schema:
        return " | ".join(json.dumps(v) for v in schema["enum"])
    if "const" in schema:
        return json.dumps(schema["const"])
    for k, sign in (("anyOf", " | "), ("oneOf", " | "), ("allOf", " & ")):
        if k in schema:
            return sign.join(type_string(m, depth + 1) for m in schema[k])
    t = schema.get("type")
    if isinstance(t, list):
        return " | ".join(t)
    if t == "array":
        return f"Array<{type_string(schema.get('items', True), depth + 1)}>"
    if t == "object" or "properties" in schema:
        needed = schema.get("required", [])
        return "{ " + "; ".join(f"{k}{'' if k in needed else '?'}: {type_string(v, depth + 1)}" for k, v in schema.get("properties", {}).items()) + " }"
    return {"integer": "number"}.get(t, t or "unknown")


def page(registry: Registry, title: str = "Schemas") -> str:
    """A page of its own with a table of classes and their links."""
    data = payload(registry)
    rows = "".join(f"<tr><td>{html.escape(n['id'])}</td><td>{n['propertyCount']}</td><td>{html.escape(', '.join(e['kind'] + ' ' + e['target'] for e in data['edges'] if e['source'] == n['id']))}</td></tr>" for n in data["nodes"])
    body = json.dumps(data).replace("</", "<\\/")
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr><th>class<th>properties<th>links</tr>{rows}</table><script type=application/json id=data>{body}</script>"
