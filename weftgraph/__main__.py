"""Command line: index a folder, then ask it. ``python -m weftgraph index|query|lookup|search|stats|overview ...``"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .operators.retrieve import flags_to_types
from .session import CACHE, CACHE_VARIABLE, GraphSession, find_cache


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph")
    p.add_argument("--cache", help=f"cache folder; else ${CACHE_VARIABLE}, else {CACHE} here or in a parent")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("folder")
    for name in ("query", "lookup", "search"):
        c = sub.add_parser(name)
        c.add_argument("text")
        c.add_argument("--json", action="store_true")
        if name == "query":
            c.add_argument("--depth", type=int, default=2)
            c.add_argument("--no-tests", action="store_true")
        if name == "lookup":
            for flag in ("calls", "callers", "inherits", "imports", "raises"):
                c.add_argument(f"--{flag}", action="store_true")
    sub.add_parser("stats")
    sub.add_parser("overview")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("weftgraph").getOrCreate()
    if a.command == "index":
        s = GraphSession.index(spark, a.folder, a.cache or os.path.join(a.folder, CACHE))
        print(json.dumps(s.stats(), default=str))
        return 0
    cache = a.cache or os.environ.get(CACHE_VARIABLE) or find_cache(os.getcwd())
    if not cache:
        print("no index found; run index first", file=sys.stderr)
        return 1
    s = GraphSession.load(spark, cache)
    if a.command in ("stats", "overview"):
        print(json.dumps(getattr(s, a.command)(), default=str))
    elif a.command == "search":
        rows = [r.asDict() for r in s.search(a.text).collect()]
        print(json.dumps(rows) if a.json else "\n".join(f"{r['quality']} {r['kind']} {r['entry']}" for r in rows))
    else:
        if a.command == "lookup":
            plan = s.lookup(a.text, flags_to_types(a.calls, a.callers, a.inherits, a.imports, a.raises)[0])
        else:
            plan = s.query(a.text, a.depth)
            plan = plan.without_tests() if a.no_tests else plan
        print(json.dumps(plan.to_dict()) if a.json else plan.format_text())
    return 0


if __name__ == "__main__":
    sys.exit(main())
