"""Command line: index a tree, ask questions of it, and keep the registry. Each command prints JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quarry.plans import index
from quarry.sources import projects
from quarry.sources.catalog import Catalog


def place(home: str, root: str) -> str:
    """Where a project's graph is kept: its folder's name and a digest of its whole path."""
    import hashlib

    return f"{home.rstrip('/')}/graphs/{root.rstrip('/').rsplit('/', 1)[-1]}-{hashlib.sha256(root.encode()).hexdigest()[:16]}"


def rows(answer: index.Answer, limit: int) -> dict:
    found = [r.asDict() for r in answer.rows.limit(limit + 1).collect()]
    gaps = answer.gaps + ([f"only the first {limit} rows are shown"] if len(found) > limit else [])
    return {"results": found[:limit], "gaps": gaps, "capabilities": answer.capabilities, "ambiguous": answer.ambiguous}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("quarry")
    out.add_argument("--home", required=True, help="folder, of any file system that Spark reads, for graphs and the registry")
    out.add_argument("--limit", type=int, default=200)
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("index", "doctor", "find", "neighbors", "blast-radius"):
        one = commands.add_parser(name)
        one.add_argument("root")
        if name == "index":
            one.add_argument("--config", help="a settings document")
        if name in ("find", "neighbors", "blast-radius"):
            one.add_argument("symbol")
        if name in ("neighbors", "blast-radius"):
            one.add_argument("--ambiguous", action="store_true")
        if name == "neighbors":
            one.add_argument("--question", default="callers")
        if name == "blast-radius":
            one.add_argument("--depth", type=int, default=3)
    commands.add_parser("status")
    commands.add_parser("forget").add_argument("roots", nargs="+")
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    known = projects.Registry(spark, f"{args.home.rstrip('/')}/registry")
    if args.command == "status":
        return projects.status(known.rows()).first().asDict() | {"digest": projects.digest(known.rows()).first().digest}
    if args.command == "forget":
        left, dropped, released = projects.forget(known.rows(), args.roots)
        said = {"dropped": [r.path for r in dropped.select("path").orderBy("path").collect()], "released": [r.path for r in released.select("path").orderBy("path").collect()]}
        known.put(left)
        for root in said["dropped"] + said["released"]:
            Catalog(spark, place(args.home, root)).wipe()
        return said
    at = place(args.home, args.root)
    if args.command == "index":
        said = {}
        if args.config:
            with open(args.config) as file:
                said = projects.settings(file.read(), args.config)
        known.put(projects.claim(known.rows(), [args.root], direct=True))
        try:
            graph = index.index(spark, args.root, said.get("exclude"), said.get("languages"), path=at)
        except Exception as error:  # the registry says how the pass ended; the caller hears of it too
            known.put(projects.mark_indexed(known.rows(), args.root, error=repr(error)[:500]))
            raise
        edges = graph.derived("edges", None)
        counts = (graph.nodes.count(), edges.count(), edges.where("resolved").count())
        known.put(projects.mark_indexed(known.rows(), args.root, counts=counts, capabilities=index.capabilities(graph)))
        return dict(zip(("nodes", "edges", "resolved"), counts))
    graph = index.reopen(spark, at, args.root)
    if args.command == "doctor":
        tiers = graph.files.groupBy("lang", "tier", "reason").count().orderBy("lang", "tier", "reason").collect()
        return {"files": [r.asDict() for r in tiers], "capabilities": index.capabilities(graph), "versions": [r.version for r in Catalog(spark, at).versions().collect()]}
    if args.command == "find":
        return rows(index.find_symbol(graph, args.symbol), args.limit)
    if args.command == "neighbors":
        return rows(index.neighbors(graph, args.symbol, args.question, args.ambiguous), args.limit)
    return rows(index.blast_radius(graph, args.symbol, args.depth, args.ambiguous), args.limit)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    json.dump(run(spark, args), sys.stdout, default=str)
    print()


if __name__ == "__main__":
    main()
