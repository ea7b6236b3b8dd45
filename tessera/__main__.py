"""Command line: python -m tessera STORE ROOT COMMAND ..., results as JSON."""

from __future__ import annotations

import argparse
import json
import sys

from tessera import tools
from tessera.engine import MODES, Engine
from tessera.session import local_session
from tessera.settings import Settings
from tessera.sources import scan


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("tessera")
    p.add_argument("store")
    p.add_argument("roots", help="folders, separated by commas")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("paths", nargs="*")
    sub.choices["index"].add_argument("--force", action="store_true")
    for name in ("scan", "status", "doctor", "map", "serve"):
        sub.add_parser(name)
    for name in ("search", "docs", "outline", "symbol", "refs", "fetch"):
        sub.add_parser(name).add_argument("query")
    sub.choices["search"].add_argument("--mode", choices=MODES, default="auto")
    sub.choices["search"].add_argument("--top-k", type=int)
    a = p.parse_args(args)
    spark, settings = local_session(), Settings.from_env()
    engine = Engine(spark, a.store, a.roots.split(","), settings)
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    if a.command == "serve":
        return tools.serve(engine, sys.stdin, sys.stdout)
    out = {
        "index": lambda: engine.reindex(a.force, a.paths or None), "scan": lambda: scan.scan_statistics(scan.list_files(spark, engine.roots, settings)), "status": engine.status, "doctor": engine.doctor,
        "map": lambda: rows(engine.repo_map()), "search": lambda: rows(engine.code_search(a.query, a.top_k, a.mode)), "symbol": lambda: rows(engine.find_symbol(a.query)), "refs": lambda: rows(engine.references(a.query)),
        "docs": lambda: rows(engine.document_search(a.query)), "outline": lambda: engine.document_outline(a.query),
        "fetch": lambda: engine.fetch(a.query),
    }[a.command]()
    json.dump(out, sys.stdout, default=str, ensure_ascii=False)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
