"""python -m lexgrain.cli: build, update and query an index."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lexgrain.operators.index import Index
from lexgrain.operators.output import run_query
from lexgrain.operators.search import SymbolWeights
from lexgrain.sources.files import read_tree


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexgrain")
    kinds = top.add_subparsers(dest="kind", required=True)
    ix = kinds.add_parser("ix").add_subparsers(dest="action", required=True)
    for action in ("build", "update"):
        p = ix.add_parser(action)
        p.add_argument("source")
        p.add_argument("-o", "--output", required=True)
        p.add_argument("-p", "--patterns", default="")
    q = kinds.add_parser("q")
    q.add_argument("index")
    q.add_argument("--json")
    q.add_argument("--cursor")
    for name in ("must", "should", "not", "lang", "ext", "path-prefix", "symbol"):
        q.add_argument(f"--{name}", default="")
    q.add_argument("--near", action="append", default=[], help="TERM,TERM:SCOPE:WINDOW")
    q.add_argument("--weights", help="a symbol weights file, or 'none'")
    q.add_argument("--max-results", type=int, default=20)
    q.add_argument("--max-hits", type=int, default=10)
    return top


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName("lexgrain").getOrCreate()
    if a.kind == "ix":
        raw = read_tree(spark, a.source, [p for p in a.patterns.split(",") if p] or None)
        if a.action == "build":
            Index.build(raw, a.source).save(a.output)
        else:  # beside the old one: it is read while the new one is written
            Index.load(spark, a.output).updated(raw).save(f"{a.output}.next")
        return 0
    if a.json:
        with open(a.json, encoding="utf-8") as f:
            data = json.load(f)
    else:
        split = lambda s: s.split(",") if s else []
        data = {k: split(getattr(a, k)) for k in ("must", "should", "not", "lang", "ext", "path_prefix", "symbol")}
        data["near"] = [{"terms": t.split(","), "scope": scope, "window": int(w)} for t, scope, w in (x.split(":") for x in a.near)]
        data |= {"budget": {"max_results": a.max_results, "max_hits": a.max_hits}, "options": {"cursor": a.cursor} if a.cursor else {}}
    try:
        weights = None if a.weights is None else SymbolWeights.disabled() if a.weights == "none" else SymbolWeights.load(spark, a.weights)
        print(json.dumps(run_query(Index.load(spark, a.index), data, weights), ensure_ascii=False))
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
