"""Command lines: `analyze` a source tree, and `layout` a graph."""

from __future__ import annotations

import argparse
import csv
import sys

from pyspark.sql import SparkSession


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sparkweft")
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyze", help="entities and relationships of a source tree, as JSON")
    a.add_argument("--repo-dir", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--no-derived", action="store_true")
    a.add_argument("--canonical-only", action="store_true")
    v = commands.add_parser("layout", help="coordinates of a graph's nodes, as CSV, or a picture, as SVG")
    v.add_argument("json_path")
    v.add_argument("-o", "--output", required=True)
    v.add_argument("--hide-unresolved", action="store_true")
    v.add_argument("--hide-derived", action="store_true")
    v.add_argument("--relationships", default="")
    v.add_argument("--layout", default="hierarchical")
    v.add_argument("--title", default="Repository graph")
    v.add_argument("--dpi", type=int, default=200, help="of no effect: the picture is one of lines")
    v.add_argument("--show", action="store_true", help="print the picture too")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("sparkweft").getOrCreate()
    if args.command == "analyze":
        from .sources.analyzer import analyze_repository

        analysis = analyze_repository(spark, args.repo_dir, not args.no_derived)
        analysis.export(args.output, args.canonical_only)
        for name, value in analysis.stats().items():
            print(f"{name}: {value}")
        print(f"canonical hash: {analysis.canonical_hash()}")
        return 0
    from .operators.draw import as_graph, visualize_graph
    from .operators.layout import compute_layout
    from .operators.query import visible

    types = [t.strip().upper() for t in args.relationships.split(",") if t.strip()]
    if args.output.endswith(".csv"):
        graph = visible(as_graph(spark, args.json_path), args.hide_unresolved, args.hide_derived, types)
        with open(args.output, "w", encoding="utf-8", newline="") as out:
            rows = csv.writer(out)
            rows.writerow(("id", "x", "y"))
            rows.writerows(compute_layout(graph, args.layout).orderBy("id").toLocalIterator())
        return 0
    if not args.output.endswith(".svg"):
        print("the output is a .svg picture or a .csv table", file=sys.stderr)
        return 1
    text = visualize_graph(args.json_path, args.output, args.hide_unresolved, args.hide_derived, types, args.layout, args.title, spark)
    if args.show:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
