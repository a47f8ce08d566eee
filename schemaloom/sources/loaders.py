"""Where schemas come from: loaders, closure over references, artefacts. Schemas are small, so all of it is on the driver."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections import OrderedDict
from collections.abc import Callable
from pathlib import Path

from ..functions.hashing import structural_hash
from ..plans.registry import Registry, subschemas

Loader = Callable[[str], dict | None]


class LoadError(RuntimeError):
    def __init__(self, message: str, retryable: bool = False):
        super().__init__(message)
        self.retryable = retryable


def memory(schemas: dict[str, dict]) -> Loader:
    return lambda schema_id: schemas.get(schema_id)


def fetch(base: str = "", headers: dict[str, str] | None = None, timeout: float = 30, opener: Callable = urllib.request.urlopen) -> Loader:
    """HTTP GET: a schema, None where the server has none, a retryable error from 500 on."""

    def load(schema_id: str) -> dict | None:
        url = schema_id if "://" in schema_id else base.rstrip("/") + "/" + schema_id.lstrip("/")
        try:
            with opener(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as response:
                return json.loads(response.read())
        except urllib.error.HTTPError as e:
            if e.code >= 500:
                raise LoadError(f"{url}: {e.code}", retryable=True) from e
            return None
        except urllib.error.URLError as e:
            raise LoadError(f"{url}: {e.reason}", retryable=True) from e

    return load


def files(folder: str) -> Loader:
    """JSON files of a folder, by $id."""
    found = {s["$id"]: s for p in sorted(Path(folder).glob("**/*.json")) if isinstance(s := json.loads(p.read_text()), dict) and "$id" in s}
    return memory(found)


def compose(*loaders: Loader) -> Loader:
    return lambda schema_id: next((s for load in loaders if (s := load(schema_id)) is not None), None)


def cached(loader: Loader, max_size: int = 1024) -> Loader:
    """Least recently used results, that there is none included."""
    kept: OrderedDict[str, dict | None] = OrderedDict()

    def load(schema_id: str) -> dict | None:
        if schema_id not in kept:
            kept[schema_id] = loader(schema_id)
            if len(kept) > max_size:
                kept.popitem(last=False)
        kept.move_to_end(schema_id)
        return kept[schema_id]

    return load


def prefetch(loader: Loader, roots: list[str], seeds: list[dict] = ()) -> dict:
    """The closure over references as {schemas, version, loadResult}: breadth first from seeds and roots."""
    registry = Registry(seeds)
    loaded, missing = [], []
    todo = [r for r in roots if not registry.has(r)] + registry.unresolved()
    while todo:
        key = todo.pop(0)
        if registry.has(key) or key in missing:
            continue
        schema = loader(key)
        if schema is None:
            missing.append(key)
            continue
        registry.set(schema if "$id" in schema else schema | {"$id": key})
        loaded.append(key)
        todo += [u for u in registry.unresolved() if u not in missing]
    return {"schemas": registry.values(), "version": 1, "loadResult": {"loaded": loaded, "missing": missing}}


def save(registry: Registry, path: str) -> None:
    """A registry with the hashes of its schemas, of their parts, and of all that each refers to."""
    entries = [{"schema": s, "hash": structural_hash(s), "semantic": registry.semantic_hash(k), "nodes": {p: structural_hash(x) for p, x in subschemas(s) if isinstance(x, dict)}} for k, s in registry.entries()]
    Path(path).write_text(json.dumps({"version": 2, "prefixes": registry.prefixes, "schemas": entries}))


def changed_parts(entry: dict) -> list[str]:
    """The pointers of the parts of a saved schema that no longer have their hash: the innermost ones, and what was added or taken away."""
    now = {p: structural_hash(x) for p, x in subschemas(entry["schema"]) if isinstance(x, dict)}
    bad = [p for p in dict.fromkeys([*entry["nodes"], *now]) if entry["nodes"].get(p) != now.get(p)]
    return [p for p in bad if not any(x != p and x.startswith(p + "/") for x in bad)]


def load(path: str) -> Registry:
    """A saved registry; a schema that no longer has its hash, or refers to one that changed, is an error that names the parts."""
    body = json.loads(Path(path).read_text())
    for entry in body["schemas"]:
        if structural_hash(entry["schema"]) != entry["hash"]:
            raise LoadError(f"{entry['schema'].get('$id')} was changed after it was saved, at {', '.join(changed_parts(entry)) or 'its root'}")
    registry = Registry([e["schema"] for e in body["schemas"]], body["prefixes"])
    for entry in body["schemas"]:
        if registry.semantic_hash(entry["schema"]["$id"]) != entry.get("semantic", registry.semantic_hash(entry["schema"]["$id"])):
            raise LoadError(f"what {entry['schema']['$id']} refers to was changed after it was saved")
    return registry


def dependants(before: Registry, after: Registry) -> list[str]:
    """The schemas of ``after`` that are new or whose meaning changed, by themselves or by what they refer to: those to compile again."""
    return [k for k in after if not before.has(k) or before.semantic_hash(k) != after.semantic_hash(k)]
