"""Command line: one document to JSON, lists of models and schemas."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from ledgerloom.functions import schemas
from ledgerloom.providers.base import CATALOG, DEFAULT_MODEL



def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom", description="Structured data from documents")
    p.add_argument("file_path", type=Path, nargs="?")
    p.add_argument("schema", nargs="?")
    p.add_argument("-m", "--model", default=DEFAULT_MODEL)
    p.add_argument("-o", "--output", type=Path)
    p.add_argument("--catalog", help="Parquet table of models, instead of the known ones: name, provider, model_id, supports_vision, input_price, output_price")
    p.add_argument("--pretty", action="store_true")
    p.add_argument("--list-models", action="store_true")
    p.add_argument("--list-schemas", action="store_true")
    return p


def model_lines(rows: list[dict]) -> list[str]:
    """Models by provider, both in order of name."""
    out = []
    for provider in sorted({r["provider"] for r in rows}):
        out.append(f"{provider.upper()}:")
        price = lambda r: "" if r.get("input_price") is None else " free" if r["input_price"] == 0 == r["output_price"] else f" {r['input_price']}/{r['output_price']}"
        out += [f"  {r['name']:<20} {r['model_id']}{price(r)}{' (vision)' if r['supports_vision'] else ''}" for r in sorted(rows, key=lambda r: r["name"]) if r["provider"] == provider]
    return out


def schema_lines() -> list[str]:
    return [f"{name}: {(s.__doc__ or 'No description').strip().splitlines()[0]}" for name, s in schemas.SCHEMAS.items()]


def main(argv: list[str] | None = None, provider=None) -> int:
    """Exit code: 0 done, 1 no such file, schema or result, 2 wrong arguments."""
    p = parser()
    args = p.parse_args(argv)
    if args.list_schemas:
        print("\n".join(schema_lines()))
        return 0
    from ledgerloom.session import local_session

    def catalog() -> list[dict]:
        if not args.catalog:
            return [{"name": n, "provider": p, "model_id": i, "supports_vision": v} for n, (p, i, v) in CATALOG.items()]
        return [r.asDict() for r in local_session(2).read.parquet(args.catalog).collect()]

    if args.list_models:
        print("\n".join(model_lines(catalog())))
        return 0
    if not args.file_path or not args.schema:
        p.error("file_path and schema are required")
    if not args.file_path.exists():
        print(f"Error: File not found: {args.file_path}", file=sys.stderr)
        return 1
    try:
        schema = schemas.schema_by_name(args.schema)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    from ledgerloom.operators.extract import extract
    from ledgerloom.providers import make, resolve
    from ledgerloom.sources.documents import from_paths, routed

    known = {r["name"]: (r["provider"], r["model_id"], r["supports_vision"]) for r in catalog()}
    try:
        name, _, vision = (provider.name, provider.model_id, provider.vision) if provider else resolve(args.model, known)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    try:
        maker = (lambda: provider) if provider else (lambda: make(args.model, known))
        maker()
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    row = extract(routed(from_paths(local_session(2), [args.file_path])), schema, maker, args.model, name, vision).first()
    if not row["success"]:
        print(f"Error: {row['error']}", file=sys.stderr)
        return 1
    text = json.dumps(row["data"].asDict(recursive=True), indent=2 if args.pretty else None, default=str)
    if args.output:
        args.output.write_text(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
