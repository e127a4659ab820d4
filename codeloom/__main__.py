"""Command line: python -m codeloom build|refresh|status|stats|search|report|impact|export ... over a folder of graph tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from codeloom.api import Graph, show, snapshot_of
from codeloom.cached import Cache, loaded_sources


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="scan source trees and write the graph")
    build.add_argument("graph")
    build.add_argument("trees", nargs="+", metavar="NAME=FOLDER")
    build.add_argument("--strict", action="store_true")
    for name, text in (("refresh", "scan changed sources only, and bring the graph up to date"), ("status", "which sources changed since the last refresh")):
        again = sub.add_parser(name, help=text)
        again.add_argument("graph")
        again.add_argument("trees", nargs="+", metavar="NAME=FOLDER")
    search = sub.add_parser("search", help="entities by a part of their name")
    search.add_argument("graph")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=25)
    export = sub.add_parser("export", help="entities and edges as JSON lines")
    export.add_argument("graph")
    export.add_argument("folder")
    sub.add_parser("stats", help="counts of a graph").add_argument("graph")
    report = sub.add_parser("report", help="unresolved, interactions, reconciliation or coverage")
    report.add_argument("kind", choices=["unresolved", "interactions", "reconciliation", "coverage"])
    report.add_argument("graph")
    impact = sub.add_parser("impact", help="what an entity reaches or is reached by")
    impact.add_argument("graph")
    impact.add_argument("entity")
    impact.add_argument("--direction", default="in")
    impact.add_argument("--depth", type=int, default=2)
    impact.add_argument("--profile", default="impact")
    return p


def main(argv: list[str]) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    if a.command in ("build", "refresh", "status"):
        trees = dict(t.split("=", 1) for t in a.trees)
        if len(trees) < len(a.trees):
            raise SystemExit("two sources have one name")
        cache = Cache(spark, f"{a.graph}/cache")
        if a.command == "build":
            Graph.build(spark, "graph", trees, a.strict).write(a.graph)
        elif a.command == "status":
            cache.status(snapshot_of(spark, trees), trees).show(truncate=False)
        else:
            done = cache.refresh("graph", trees)
            done.status.show(truncate=False)
            print(cache.load(done, a.graph, "graph", loaded_sources(spark, a.graph)))
        return
    graph = Graph.read(spark, a.graph, "graph")
    if a.command == "stats":
        graph.stats().show()
    elif a.command == "search":
        graph.search(a.query, limit=a.limit).show(a.limit, truncate=False)
    elif a.command == "export":
        graph.export(a.folder)
    elif a.command == "report" and a.kind == "coverage":
        graph.coverage().show(truncate=False)
    elif a.command == "impact":
        show(graph.impact(a.entity, direction=a.direction, depth=a.depth, profile=a.profile))
    else:
        show(getattr(graph, a.kind)())


if __name__ == "__main__":
    main(sys.argv[1:])
