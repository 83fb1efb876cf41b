"""A graph as an SVG picture: styles by type, legends of what there is, counts under the title.

A picture has as many elements as the graph; it is for graphs that someone looks at. Layouts of any
size are tables (layout.compute_layout).
"""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import node_label
from .graph import PropertyGraph
from .layout import compute_layout
from .query import visible

#: Fill, rim and form of nodes, by type.
NODE_STYLES = {
    "Repository": ("#5b4b8a", "#2e2350", "circle"), "Directory": ("#2a9d8f", "#14524b", "circle"), "File": ("#4895ef", "#1d4e89", "square"), "Class": ("#f4a261", "#a85b12", "triangle"),
    "Function": ("#588157", "#2f4a2e", "circle"), "Method": ("#a3b18a", "#5d6b45", "circle"), "Module": ("#adb5bd", "#6c757d", "square"), "UnresolvedReference": ("#e76f51", "#8c2f17", "diamond"),
}
#: Colour, dashes, width and bend of edges, by type.
EDGE_STYLES = {
    "CONTAINS": ("#8d99ae", "", 1.2, 0.0), "IMPORTS": ("#3a86ff", "6 3", 1.6, 0.12), "CALLS": ("#c1121f", "", 1.6, 0.18),
    "INHERITS": ("#7b2cbf", "8 3 2 3", 1.8, -0.15), "DEFINED_IN": ("#6c757d", "2 4", 1.2, 0.08), "DEPENDS_ON": ("#fb8500", "2 3", 2.0, -0.2),
}
UNIT, SIZE, MARGIN = 60.0, 14.0, 160.0


def as_graph(spark: SparkSession, source: PropertyGraph | str | Path | dict) -> PropertyGraph:
    """A graph as it is; a document's dict, its JSON text, or the path of a file with it."""
    from ..sources.graph_io import import_json

    if isinstance(source, PropertyGraph):
        return source
    if isinstance(source, dict):
        return import_json(spark, json.dumps(source))
    if isinstance(source, (str, Path)):
        return import_json(spark, source)
    raise TypeError(f"a graph, a document or a path, not {type(source).__name__}")


def drawing(graph: PropertyGraph, layout: str = "hierarchical") -> tuple[DataFrame, DataFrame]:
    """What is drawn: nodes (id, x, y, label, style) and edges (source, target, type, x1, y1, x2, y2)."""
    style = F.when(F.coalesce("is_synthetic", F.lit(False)), "UnresolvedReference").otherwise(F.col("type"))
    named = graph.nodes.select("id", node_label(F.col("is_synthetic"), F.col("type"), F.col("name"), F.col("raw_call"), F.col("id")).alias("label"), style.alias("style"))
    nodes = named.join(compute_layout(graph, layout), "id")
    at = lambda end, n: nodes.select(F.col("id").alias(end), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    return nodes, graph.edges.select("source", "target", "type").join(at("source", 1), "source").join(at("target", 2), "target")


def _form(kind: str, x: float, y: float, fill: str, rim: str) -> str:
    paint = f'fill="{fill}" stroke="{rim}" stroke-width="1.5"'
    if kind == "circle":
        return f'<circle cx="{x:g}" cy="{y:g}" r="{SIZE:g}" {paint}/>'
    corners = {"square": [(-1, -1), (1, -1), (1, 1), (-1, 1)], "triangle": [(0, -1.2), (1.1, 0.9), (-1.1, 0.9)], "diamond": [(0, -1.2), (1, 0), (0, 1.2), (-1, 0)]}[kind]
    points = " ".join(f"{x + a * SIZE:g},{y + b * SIZE:g}" for a, b in corners)
    return f'<polygon points="{points}" {paint}/>'


def svg(graph: PropertyGraph, layout: str = "hierarchical", title: str = "Repository graph") -> str:
    """The picture as SVG text; of an empty graph a sheet that says so."""
    head = '<svg xmlns="http://www.w3.org/2000/svg" font-family="sans-serif"'
    if graph.nodes.isEmpty():
        return f'{head} width="480" height="120"><text x="240" y="50" text-anchor="middle" font-size="16">{escape(title)}</text><text x="240" y="80" text-anchor="middle">No nodes</text></svg>\n'
    nodes, edges = (table.persist() for table in drawing(graph, layout))
    box = nodes.agg(F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("low"), F.max("y").alias("high")).first()
    width, height = (box.right - box.left) * UNIT + 2 * MARGIN, (box.high - box.low) * UNIT + 2 * MARGIN
    place = lambda x, y: ((x - box.left) * UNIT + MARGIN, (box.high - y) * UNIT + MARGIN)
    lines, kinds, types, total, synthetic = [], set(), set(), 0, 0
    for e in edges.orderBy("type", "source", "target").toLocalIterator():
        colour, dashes, wide, bend = EDGE_STYLES.get(e.type, ("#000000", "", 1.0, 0.0))
        (x1, y1), (x2, y2) = place(e.x1, e.y1), place(e.x2, e.y2)
        types.add(e.type)
        total += 1
        middle = f"{(x1 + x2) / 2 + (y2 - y1) * bend:g} {(y1 + y2) / 2 - (x2 - x1) * bend:g}"
        dash = f' stroke-dasharray="{dashes}"' if dashes else ""
        lines.append(f'<path class="edge" d="M {x1:g} {y1:g} Q {middle} {x2:g} {y2:g}" fill="none" stroke="{colour}" stroke-width="{wide:g}"{dash} opacity="0.8"/>')
    n = 0
    for v in nodes.orderBy("id").toLocalIterator():
        fill, rim, form = NODE_STYLES.get(v.style, NODE_STYLES["Module"])
        x, y = place(v.x, v.y)
        kinds.add(v.style)
        n += 1
        synthetic += v.style == "UnresolvedReference"
        lines.append(f'<g class="node">{_form(form, x, y, fill, rim)}<text x="{x:g}" y="{y + 2.2 * SIZE:g}" text-anchor="middle" font-size="10">{escape(v.label)}</text></g>')
    lines.append('<g class="legend" font-size="11">')
    for i, kind in enumerate(k for k in NODE_STYLES if k in kinds):
        fill, rim, form = NODE_STYLES[kind]
        lines.append(f'{_form(form, 24, 34 + 34 * i, fill, rim)}<text x="46" y="{38 + 34 * i}">{kind}</text>')
    for i, kind in enumerate(k for k in EDGE_STYLES if k in types):
        colour, dashes, wide, _ = EDGE_STYLES[kind]
        lines.append(f'<line x1="{width - 140:g}" x2="{width - 110:g}" y1="{34 + 20 * i}" y2="{34 + 20 * i}" stroke="{colour}" stroke-width="{wide:g}" stroke-dasharray="{dashes}"/><text x="{width - 104:g}" y="{38 + 20 * i}">{kind}</text>')
    lines.append("</g>")
    counts = f"{n} nodes ({n - synthetic} repository entities, {synthetic} placeholders), {total} relationships"
    middle = f'x="{width / 2:g}" text-anchor="middle"'
    lines.append(f'<text {middle} y="30" font-size="18">{escape(title)}</text><text {middle} y="52" font-size="12">{counts}</text>')
    for table in (nodes, edges):
        table.unpersist()
    return "\n".join([f'{head} width="{width:g}" height="{height:g}" viewBox="0 0 {width:g} {height:g}">', *lines, "</svg>\n"])


def visualize_graph(source: Any, path: str | Path | None = None, hide_unresolved: bool = False, hide_derived: bool = False, relationships: list[str] | None = None, layout: str = "hierarchical", title: str = "Repository graph", spark: SparkSession | None = None) -> str:
    """The picture of a graph, document or file (see as_graph), without what is hidden; written to the path if there is one."""
    graph = as_graph(spark or (source.spark if isinstance(source, PropertyGraph) else SparkSession.active()), source)
    text = svg(visible(graph, hide_unresolved, hide_derived, relationships), layout, title)
    if path is not None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
    return text
