"""Command line: build artefacts, ontologies and shapes from schema files; schemas from ontologies; a page of a registry."""

from __future__ import annotations

import argparse
import glob
import json
from pathlib import Path

from .onto import emit, importer, viz
from .plans.registry import Registry
from .sources import loaders


def _registry(patterns: list[str]) -> Registry:
    return Registry(json.loads(Path(p).read_text()) for pattern in patterns for p in sorted(glob.glob(pattern, recursive=True)))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="schemaloom")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("kind", choices=["artifact", "schema", "ontology", "shacl"])
    view = commands.add_parser("viz")
    for c in (build, view):
        c.add_argument("schemas", nargs="+")
        c.add_argument("--out", required=True)
    owl = commands.add_parser("owl-gen")
    owl.add_argument("nquads")
    owl.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    if args.command == "owl-gen":
        from .operators.quads import read_nquads
        from .session import session

        Path(args.out).write_text(importer.codegen(importer.import_owl(read_nquads(session(), args.nquads))))
        return 0
    registry = _registry(args.schemas)
    if args.command == "viz":
        Path(args.out).write_text(viz.page(registry))
    elif args.kind == "artifact":
        loaders.save(registry, args.out)
    elif args.kind == "schema":
        Path(args.out).write_text(json.dumps(registry.values(), indent=1))
    else:
        made = emit.owl(registry) if args.kind == "ontology" else emit.shacl(registry)
        Path(args.out).write_text(json.dumps(emit.document(made, registry.base + args.kind), indent=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
