"""Coordinates for drawing a graph: levels by containment, or by type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, kept, to_all
from ..functions.numbering import numbered
from .graph import PropertyGraph
from .traverse import reached

# The level of a node that containment doesn't reach, by type; of other types; of synthetic nodes.
LEVELS = {"Repository": 0, "Directory": 1, "File": 2, "Class": 3, "Function": 3, "Method": 4, "UnresolvedReference": 5}
OTHER_LEVEL, SYNTHETIC_LEVEL = 2, 5


def _level_of_type():
    out = F.lit(OTHER_LEVEL)
    for kind, level in LEVELS.items():
        out = F.when(F.col("type") == kind, level).otherwise(out)
    return out


def node_levels(graph: PropertyGraph) -> DataFrame:
    """(id, level): least distance over CONTAINS from a node that contains others and that nothing contains.

    Where there is none, the roots are the nodes that no edge enters, or else the first node. What no
    root reaches has the level of synthetic nodes, or that of its type.
    """
    contains = kept(graph.edges.where("type = 'CONTAINS'").select("source", "target"))
    holders = kept(contains.select(F.col("source").alias("id")).distinct())
    n = holders.count()
    entered = contains.select(F.col("target").alias("id")).join(to_all(holders, n), "id", "left_semi")
    roots = kept(holders.join(entered, "id", "left_anti"))
    among = None
    if roots.isEmpty():
        among = contains.select(F.col("source").alias("id")).union(contains.select("target")).distinct()
        roots = graph.nodes.select("id").join(graph.edges.select(F.col("target").alias("id")), "id", "left_anti")
        if roots.isEmpty():
            roots = graph.nodes.orderBy("node_ord").limit(1).select("id")
    depth = reached(roots, contains.toDF("at", "to"), starts=(holders, n))
    if among is not None:
        depth = depth.join(among, "id", "left_semi")  # other roots need not contain anything
    synthetic = F.coalesce("is_synthetic", F.lit(False)) | (F.col("type") == "UnresolvedReference")
    return graph.nodes.join(depth, "id", "left").select("id", F.coalesce("hop", F.when(synthetic, SYNTHETIC_LEVEL), _level_of_type()).alias("level"))


def hierarchical_layout(graph: PropertyGraph, horizontal: float = 3.0, vertical: float = 2.4) -> DataFrame:
    """(id, x, y): each level centred, its nodes by the mean x of the parents placed above, then by id.

    Parents are the containing nodes; a node without any goes by all nodes with edges to it.
    """
    levels = cut(node_levels(graph))
    edges = cut(graph.edges.select("source", F.col("target").alias("id"), (F.col("type") == "CONTAINS").alias("holds")))
    placed = graph.spark.createDataFrame([], "id string, x double, y double")
    for level, width in sorted((r.level, r["count"]) for r in levels.groupBy("level").count().collect()):  # a row a level
        here = levels.where(F.col("level") == level).select("id")
        above = edges.join(here, "id", "left_semi").join(placed.select(F.col("id").alias("source"), "x"), "source")
        # Parallel edges count each, but a containing node once.
        by_source = above.groupBy("id", "source").agg(F.first("x").alias("x"), F.count("*").alias("n"), F.max("holds").alias("holds"))
        means = by_source.groupBy("id").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("near"), F.avg(F.when(F.col("holds"), F.col("x"))).alias("held"))
        order = here.join(means, "id", "left").select("id", F.coalesce("held", "near", F.lit(0.0)).alias("mean"))
        x = F.col("place") * horizontal - (width - 1) * horizontal / 2
        placed = cut(placed.union(numbered(order, "mean", "id").select("id", x.alias("x"), F.lit(-level * vertical).alias("y"))))
    return placed


def multipartite_layout(graph: PropertyGraph) -> DataFrame:
    """(id, x, y): a column a type, its nodes by id around the middle."""
    placed = numbered(graph.nodes.select(F.coalesce("type", F.lit("")).alias("type"), "id"), "type", "id")
    sizes, begins, total = sorted((r.type, r["count"]) for r in placed.groupBy("type").count().collect()), [], 0  # a row a type
    for kind, n in sizes:
        begins.append((kind, total, n))
        total += n
    columns = graph.spark.createDataFrame(begins, "type string, begin long, size long")
    y = F.col("place") - F.col("begin") - (F.col("size") - 1) / 2
    return placed.join(F.broadcast(columns), "type").select("id", _level_of_type().cast("double").alias("x"), y.alias("y"))


def compute_layout(graph: PropertyGraph, layout: str = "hierarchical") -> DataFrame:
    if layout == "hierarchical":
        return hierarchical_layout(graph)
    if layout == "multipartite":
        return multipartite_layout(graph)
    raise ValueError(f"Unknown layout {layout!r}: 'hierarchical' or 'multipartite'. A spring layout, which depends on one library's random numbers, is not offered.")
