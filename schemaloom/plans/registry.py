"""Schema registry: JSON Schema 2020-12 documents by $id, with references resolved on the driver.

Extension keywords are recognised by their local name under any prefix: ``<prefix>:alias`` or ``x-<prefix>-alias`` are
both the extension keyword ``alias``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from ..functions.hashing import structural_hash, structural_text

Schema = dict[str, Any] | bool

DIALECT = "https://json-schema.org/draft/2020-12/schema"
#: Characteristics that contradict each other on one property.
CONFLICTS = (("symmetric", "asymmetric"), ("reflexive", "irreflexive"), ("asymmetric", "reflexive"))
#: Keywords whose value is a schema, a list of schemas, or a map of schemas.
ONE = ("items", "contains", "additionalProperties", "propertyNames", "unevaluatedItems", "unevaluatedProperties", "not", "if", "then", "else")
MANY = ("allOf", "anyOf", "oneOf", "prefixItems")
MAPPED = ("properties", "patternProperties", "dependentSchemas", "$defs", "definitions")


class SchemaError(ValueError):
    """A schema that can't be registered or resolved."""


def ext(schema: Schema, name: str, default: Any = None) -> Any:
    """The value of an extension keyword, whatever its prefix."""
    if isinstance(schema, dict):
        for k, v in schema.items():
            if k.endswith(":" + name) and not k.startswith(("rdfs:", "owl:", "rdf:", "sh:")) or re.fullmatch(rf"x-[a-z]+-{name}", k):
                return v
    return default


def config(schema: Schema) -> dict:
    return ext(schema, "config") or {}


def subschemas(schema: Schema, pointer: str = "") -> Iterator[tuple[str, Schema]]:
    """(JSON pointer, schema) of a schema and all that it holds, in document order."""
    yield pointer, schema
    if not isinstance(schema, dict):
        return
    for k, v in schema.items():
        if k in ONE and isinstance(v, (dict, bool)):
            yield from subschemas(v, f"{pointer}/{k}")
        elif k in MANY and isinstance(v, list):
            for i, x in enumerate(v):
                yield from subschemas(x, f"{pointer}/{k}/{i}")
        elif k in MAPPED and isinstance(v, dict):
            for n, x in v.items():
                yield from subschemas(x, f"{pointer}/{k}/{n.replace('~', '~0').replace('/', '~1')}")


class Registry:
    """Schemas by $id in registration order. Small and on the driver; ``listing()`` and ``nodes()`` give DataFrames of it."""

    def __init__(self, schemas: Iterable[dict] = (), prefixes: dict[str, str] | None = None, base: str = "urn:schemaloom:"):
        self.prefixes = dict(prefixes or {})
        self.base = base
        self.revision = 0
        self._schemas: dict[str, dict] = {}
        self.invariants: dict[str, dict[str, Callable]] = {}
        self.computed: dict[str, dict[str, Callable]] = {}
        self.transforms: dict[str, tuple[Callable, Callable]] = {}
        self.keywords: dict[str, tuple[Callable, str | None]] = {}
        self.same: set[tuple[str, str]] = set()
        self.different: set[tuple[str, str]] = set()
        self.characteristics: dict[str, set[str]] = {}
        for s in schemas:
            self.set(s)

    # catalogue

    def expand(self, name: str) -> str:
        """A CURIE as an IRI; the longest matching prefix is the one before the first colon."""
        head, colon, tail = name.partition(":")
        return self.prefixes[head] + tail if colon and head in self.prefixes and not tail.startswith("//") else name

    def compact(self, iri: str) -> str:
        """An IRI as a CURIE under the longest namespace that it starts with."""
        best = max((p for p in self.prefixes if iri.startswith(self.prefixes[p])), key=lambda p: len(self.prefixes[p]), default=None)
        return f"{best}:{iri[len(self.prefixes[best]):]}" if best is not None else iri

    def set(self, schema: dict | dict[str, dict] | Iterable[dict], schema_id: str | None = None) -> Registry:
        """Register one schema, a map of id to schema, or several; a schema replaces an earlier one of its id."""
        if isinstance(schema, dict) and "$id" not in schema and schema and all(isinstance(v, dict) and "$id" in v for v in schema.values()):
            for k, v in schema.items():
                if self.expand(k) != self.expand(v["$id"]):
                    raise SchemaError(f"the key {k} isn't the $id {v['$id']}")
                self.set(v)
            return self
        if not isinstance(schema, dict):
            for s in schema:
                self.set(s)
            return self
        if not isinstance(schema.get("$id"), str):
            raise SchemaError("a schema needs an $id")
        if schema.get("$schema", DIALECT).rstrip("#") != DIALECT:
            raise SchemaError(f"the dialect {schema['$schema']} isn't supported")
        key = self.expand(schema["$id"])
        anchors = [s["$anchor"] for _, s in subschemas(schema) if isinstance(s, dict) and "$anchor" in s]
        if len(anchors) != len(set(anchors)):
            raise SchemaError(f"{key} has an anchor twice")
        for _, s in subschemas(schema):
            for a, b in CONFLICTS:
                if isinstance(s, dict) and s.get(a) is True and s.get(b) is True:
                    raise SchemaError(f"{key} has a property that is {a} and {b}")
        self._schemas.pop(key, None)
        self._schemas[key] = json.loads(json.dumps(schema))
        self.revision += 1
        return self

    def register_anonymous(self, schema: dict) -> str:
        key = f"{self.base}hash:{structural_hash(schema)}"
        self.set(schema | {"$id": key})
        return key

    def get(self, schema_id: str) -> dict | None:
        return self._schemas.get(self.expand(schema_id))

    def __getitem__(self, schema_id: str) -> dict:
        found = self.get(schema_id)
        if found is None:
            raise SchemaError(f"no schema {schema_id}")
        return found

    def has(self, schema_id: str) -> bool:
        return self.expand(schema_id) in self._schemas

    def delete(self, schema_id: str) -> bool:
        self.revision += 1
        return self._schemas.pop(self.expand(schema_id), None) is not None

    def clear(self) -> None:
        self.revision += 1
        self._schemas.clear()

    def keys(self) -> list[str]:
        return list(self._schemas)

    def values(self) -> list[dict]:
        return list(self._schemas.values())

    def entries(self) -> list[tuple[str, dict]]:
        return list(self._schemas.items())

    def __len__(self) -> int:
        return len(self._schemas)

    # references

    def resolve(self, ref: str, root: str) -> tuple[str, Schema]:
        """(id of the document, schema) that a $ref names from within the document ``root``."""
        target, _, fragment = ref.partition("#")
        doc_id = self.expand(target) if target else root
        doc = self.get(doc_id)
        if doc is None:
            raise SchemaError(f"no schema {doc_id} for the reference {ref}")
        return doc_id, self.fragment(doc, fragment, ref)

    def fragment(self, doc: Schema, fragment: str, ref: str = "") -> Schema:
        if not fragment:
            return doc
        if fragment.startswith("/"):
            at: Any = doc
            for part in fragment[1:].split("/"):
                part = part.replace("~1", "/").replace("~0", "~")
                at = at[int(part)] if isinstance(at, list) else at.get(part) if isinstance(at, dict) else None
                if at is None:
                    raise SchemaError(f"the reference {ref or fragment} leads nowhere")
            return at
        for _, s in subschemas(doc):
            if isinstance(s, dict) and fragment in (s.get("$anchor"), s.get("$dynamicAnchor")):
                return s
        raise SchemaError(f"no anchor {fragment}")

    def subschema_at(self, schema_id: str, pointer: str) -> dict:
        """Register and return the part of a schema at a JSON pointer, under id#pointer."""
        part = self.fragment(self[schema_id], pointer.lstrip("#"))
        made = dict(part) | {"$id": f"{self.expand(schema_id)}#{pointer.lstrip('#')}"}
        self.set(made)
        return made

    def unresolved(self) -> list[str]:
        """References to documents that aren't registered."""
        missing = dict.fromkeys(
            self.expand(s["$ref"].partition("#")[0]) for key in self for _, s in subschemas(self[key]) if isinstance(s, dict) and isinstance(s.get("$ref"), str) and s["$ref"].partition("#")[0] and not self.has(s["$ref"].partition("#")[0])
        )
        return list(missing)

    def __iter__(self) -> Iterator[str]:
        return iter(list(self._schemas))

    def reachable(self, schema_id: str) -> list[str]:
        """The documents that one refers to, directly or not, itself first; those that aren't registered are left out."""
        out, todo = [], [self.expand(schema_id)]
        while todo:
            key = todo.pop(0)
            if key in out or not self.has(key):
                continue
            out.append(key)
            anchors: set[str] = set()
            for _, s in subschemas(self[key]):
                for k in ("$ref", "$dynamicRef", "disjointWith", "rdfs:range") if isinstance(s, dict) else ():
                    for ref in s[k] if isinstance(s.get(k), list) else [s.get(k)]:
                        ref = ref.get("$ref") if isinstance(ref, dict) else ref
                        if isinstance(ref, str):
                            todo.append(self.expand(ref.partition("#")[0]) or key)
                            anchors |= {ref.partition("#")[2]} if k == "$dynamicRef" else set()
            todo += [d for d in self if anchors and any(isinstance(s, dict) and s.get("$dynamicAnchor") in anchors for _, s in subschemas(self[d]))]
        return out

    def semantic_hash(self, schema_id: str, exact: bool = False) -> str:
        """A hash of a schema and of all that it refers to: it changes with any of these, and with no other.

        ``exact`` hashes the documents as they are written, else by their structure, in which annotations don't count.
        """
        of = (lambda s: json.dumps(s)) if exact else structural_text
        parts = [self.expand(schema_id), *(x for key in sorted(self.reachable(schema_id)) for x in (key, of(self[key])))]
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()

    def parents(self, schema_id: str) -> list[str]:
        """The schemas that one refers to in its allOf: its direct superclasses."""
        return [self.expand(m["$ref"].partition("#")[0]) for m in self[schema_id].get("allOf", []) if isinstance(m, dict) and isinstance(m.get("$ref"), str) and m["$ref"].partition("#")[0]]

    def ancestors(self, schema_id: str) -> list[str]:
        out: list[str] = []
        todo = self.parents(schema_id)
        while todo:
            p = todo.pop(0)
            if p not in out:
                out.append(p)
                todo += self.parents(p) if self.has(p) else []
        return out

    def properties(self, schema_id: str) -> dict[str, Schema]:
        """Effective properties: own, then those of allOf, anyOf, oneOf, then and else; the first definition wins."""
        out: dict[str, Schema] = {}

        def walk(schema: Schema, root: str, seen: frozenset) -> None:
            if not isinstance(schema, dict):
                return
            if "$ref" in schema:
                if schema["$ref"] in seen:
                    return
                doc, target = self.resolve(schema["$ref"], root)
                return walk(target, doc, seen | {schema["$ref"]})
            for k, v in schema.get("properties", {}).items():
                out.setdefault(k, v)
            for key in ("allOf", "anyOf", "oneOf"):
                for m in schema.get(key, []):
                    walk(m, root, seen)
            for key in ("then", "else"):
                walk(schema.get(key, True), root, seen)

        walk(self[schema_id], self.expand(schema_id), frozenset())
        return out

    # identity axioms

    def same_as(self, a: str, b: str) -> None:
        self.same.add(tuple(sorted((a, b))))

    def different_from(self, a: str, b: str) -> None:
        self.different.add(tuple(sorted((a, b))))

    def add_characteristic(self, predicate: str, kind: str) -> None:
        """Say of a predicate that it is functional, symmetric, transitive and so on; kinds that contradict each other are an error."""
        known = self.characteristics.setdefault(self.expand(predicate), set())
        for a, b in CONFLICTS:
            if kind in (a, b) and (known & {a, b}) - {kind}:
                raise SchemaError(f"{predicate} can't be {a} and {b}")
        known.add(kind)

    def assert_identity_consistency(self) -> None:
        up: dict[str, str] = {}

        def find(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in self.same:
            up[find(a)] = find(b)
        for a, b in self.different:
            if find(a) == find(b):
                raise SchemaError(f"{a} and {b} are the same and different")

    # user functions

    def add_invariant(self, schema_id: str, name: str, column: Callable) -> None:
        """``column(row accessor)`` gives a Column: null where the invariant holds, else a message."""
        self.invariants.setdefault(self.expand(schema_id), {})[name] = column

    def remove_invariant(self, schema_id: str, name: str) -> None:
        self.invariants.get(self.expand(schema_id), {}).pop(name, None)

    def add_computed(self, schema_id: str, name: str, column: Callable) -> None:
        self.computed.setdefault(self.expand(schema_id), {})[name] = column

    def remove_computed(self, schema_id: str, name: str) -> None:
        self.computed.get(self.expand(schema_id), {}).pop(name, None)

    def add_transform(self, schema_id: str, decode: Callable, encode: Callable) -> None:
        """Column functions both ways, applied wherever the schema is referred to."""
        self.transforms[self.expand(schema_id)] = (decode, encode)

    def add_transform_chain(self, schema_id: str, *steps: tuple[Callable, Callable]) -> None:
        """Pairs of (decode, encode) one after another: decoding goes through them in order, encoding back."""

        def decode(c):
            for step, _ in steps:
                c = step(c)
            return c

        def encode(c):
            for _, step in reversed(steps):
                c = step(c)
            return c

        self.add_transform(schema_id, decode, encode)

    def add_keyword(self, name: str, column: Callable, only: str | None = None) -> None:
        """``column(value, argument)`` gives a boolean Column; ``only`` names the JSON type that it applies to."""
        self.keywords[name] = (column, only)

    # duplicates and listings

    def find_duplicates(self) -> list[tuple[str, str, str]]:
        """(owner id, pointer, id of the equal top-level schema): a hash that several top-level schemas share matches none."""
        top: dict[str, list[str]] = {}
        for key in self:
            top.setdefault(structural_hash(self[key]), []).append(key)
        out = []
        for key in self:
            for pointer, s in subschemas(self[key]):
                if pointer and isinstance(s, dict) and "$ref" not in s:
                    match = top.get(structural_hash(s), [])
                    if len(match) == 1 and match[0] != key:
                        out.append((key, pointer, match[0]))
        return out

    def listing(self, spark):
        rows = [(k, json.dumps(s), structural_hash(s)) for k, s in self._schemas.items()]
        return spark.createDataFrame(rows, "schema_id string, body string, hash string")

    def relations(self, spark):
        """source, pointer, kind, target: what schemas say of each other and of their own parts, one row for each statement.

        A reference is of the kind of the keyword that it stands under (a reference in allOf is a subclass), a sub-schema of
        the kind that leads to it, with its own pointer as the target.
        """
        rows = []
        for key in self:
            for pointer, s in subschemas(self[key]):
                if not isinstance(s, dict):
                    continue
                place = pointer.split("/")
                under = next((x for x in reversed(place) if x in (*ONE, *MANY, *MAPPED)), "")
                for k in ("$ref", "$dynamicRef"):
                    if isinstance(s.get(k), str):
                        kind = "subClassOf" if place[1:2] == ["allOf"] and len(place) == 3 else "range" if place[1:2] == ["properties"] and len(place) == 3 else under or "sameSchema"
                        rows.append((key, pointer, kind, self.expand(s[k]) if not s[k].startswith("#") else key + s[k]))
                for k in ("disjointWith", "equivalentTo", "rdfs:range"):
                    for t in s[k] if isinstance(s.get(k), list) else [s[k]] if k in s else []:
                        rows.append((key, pointer, k.removeprefix("rdfs:"), self.expand(t["$ref"] if isinstance(t, dict) else t)))
                rows += [(key, pointer, "inverseFunctional", f"{key}#{place[-1]}")] if s.get("inverseFunctional") else []
                rows += [(key, pointer, "required", f"{key}#{n}") for n in s.get("required", [])]
                if pointer:
                    rows.append((key, pointer, f"has {under}", f"{key}#{pointer}"))
        return spark.createDataFrame(rows, "source string, pointer string, kind string, target string")

    def tree(self, spark):
        """schema_id, pointer, parent, depth: where each sub-schema stands; going up and down is a join on parent."""
        rows = []
        for key in self:
            known = [p for p, _ in subschemas(self[key])]
            for p in known:
                above = [x for x in known if x != p and p.startswith(x + "/")]
                rows.append((key, p, max(above, key=len) if above else None, len(above)))
        return spark.createDataFrame(rows, "schema_id string, pointer string, parent string, depth int")

    def nodes(self, spark):
        """schema_id, pointer, body, hash: every sub-schema, for analytics (duplicates are then a join on hash)."""
        rows = [(k, p, json.dumps(s), structural_hash(s)) for k in self for p, s in subschemas(self[k])]
        return spark.createDataFrame(rows, "schema_id string, pointer string, body string, hash string")
