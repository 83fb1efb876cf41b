"""Lookups, filters and statistics over a graph."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lineage
from ..functions import schema as S
from ..functions.lineage import LISTED, SENT, dropped, few, kept, to_all
from ..functions.scalars import contains_ignoring_case
from .graph import PropertyGraph


def get_node(graph: PropertyGraph, node_id: str) -> dict[str, Any] | None:
    return graph.get_node(node_id)


def find_nodes_by_name(graph: PropertyGraph, name: str, node_type: str | None = None, exact: bool = True) -> DataFrame:
    """Nodes with the name, or with it as a part in any case, by id."""
    found = graph.nodes.where(F.col("name") == name if exact else contains_ignoring_case("name", name))
    if node_type is not None:
        found = found.where(F.col("type") == S.node_type(node_type))
    return found.orderBy("id")


def find_nodes_by_type(graph: PropertyGraph, node_type: str) -> DataFrame:
    return graph.nodes.where(F.col("type") == S.node_type(node_type)).orderBy("id")


def get_repository_entities(graph: PropertyGraph, include_synthetic: bool = False) -> DataFrame:
    found = graph.nodes if include_synthetic else graph.nodes.where(~F.coalesce("is_synthetic", F.lit(False)))
    return found.orderBy("id")


def get_synthetic_nodes(graph: PropertyGraph) -> DataFrame:
    return graph.nodes.where("is_synthetic").orderBy("id")


def get_relationships_by_type(graph: PropertyGraph, rel_type: str) -> DataFrame:
    return graph.edges.where(F.col("type") == S.relationship_type(rel_type))


def get_relationships(graph: PropertyGraph, source_id: str | None = None, target_id: str | None = None, rel_type: str | None = None) -> DataFrame:
    """Edges that meet every condition given."""
    found = graph.edges
    for column, value in (("source", source_id), ("target", target_id), ("type", None if rel_type is None else S.relationship_type(rel_type))):
        if value is not None:
            found = found.where(F.col(column) == value)
    return found


def parallel_edges(graph: PropertyGraph) -> DataFrame:
    """Pairs of nodes with more than one edge, and how many."""
    return graph.edges.groupBy("source", "target").agg(F.count("*").alias("edges")).where("edges > 1")


def visible(graph: PropertyGraph, hide_unresolved: bool = False, hide_derived: bool = False, rel_types: list[str] | None = None) -> PropertyGraph:
    """The part of a graph to draw: no edge without both ends; an empty list of types allows all."""
    nodes = graph.nodes.where(~F.coalesce("is_synthetic", F.lit(False))) if hide_unresolved else graph.nodes
    edges = graph.edges
    if hide_derived:
        edges = edges.where(~F.coalesce("is_derived", F.lit(False)) & ~F.col("type").isin(*S.DERIVED_TYPES))
    if rel_types:
        edges = edges.where(F.col("type").isin(S.relationship_types(rel_types)))
    return PropertyGraph(nodes, induced(edges, nodes.select("id")), graph.metadata)


def induced(edges: DataFrame, ids: DataFrame, n: int | None = None) -> DataFrame:
    """Edges with both ends among the ids (n, if their number is known); a short list of ids goes into the edges' own filter."""
    listed = few(ids, "id", LISTED)
    if listed is not None:
        return edges.where(F.col("source").isin(listed) & F.col("target").isin(listed))
    if n is not None and n <= SENT:
        among = lambda end: F.broadcast(ids.select(F.col("id").alias(end)))
        return edges.join(among("source"), "source", "left_semi").join(among("target"), "target", "left_semi").select(*edges.columns)
    lost = missing_ends(edges, ids)
    m = lost.count()
    without = lambda end: to_all(lost.select(F.col("id").alias(end)), m)
    return edges.where("source IS NOT NULL AND target IS NOT NULL").join(without("source"), "source", "left_anti").join(without("target"), "target", "left_anti").select(*edges.columns)


def missing_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id) of the distinct ends of edges that are not among the ids, kept.

    Most edges lack none, so their own rows need not be shuffled. Ends and ids are compared in passes
    over parts of the identifiers, of bounded numbers of rows each.
    """
    ends, there = kept(edges.select("source", "target")), kept(ids.select("id"))
    passes = -(-(2 * ends.count() + there.count()) // lineage.AT_ONCE) or 1
    each = ends.select(F.explode(F.array("source", "target")).alias("id")).where("id IS NOT NULL")
    found = None
    for i in range(passes):
        part = F.pmod(F.xxhash64("id"), F.lit(passes)) == i
        lost = kept(each.where(part).join(there.where(part), "id", "left_anti").distinct())
        found = lost if found is None else found.union(lost)
    dropped(ends)
    dropped(there)
    return found


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among the ids: those that would dangle without these nodes."""
    listed = few(ids, "id", LISTED)
    if listed is not None:
        return edges.where(F.col("source").isin(listed) | F.col("target").isin(listed))
    ids = kept(ids.select("id").distinct())
    n = ids.count()
    at = lambda end: to_all(ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), n)
    return edges.join(at("source"), "source", "left").join(at("target"), "target", "left").where("_source OR _target").select(*edges.columns)


def statistics_table(graph: PropertyGraph) -> DataFrame:
    """get_statistics as rows (statistic, value): totals, and counts of nodes:<type> and edges:<type>."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.coalesce("type", F.lit("Unknown"))
    primitive = F.col("type").isin(*S.PRIMITIVE_TYPES) & ~flag("is_derived")
    unresolved = (F.col("type") == "CALLS") & (F.startswith("target", F.lit("unresolved:")) | flag("is_unresolved"))
    nodes = graph.nodes.groupBy(kind.alias("type")).agg(F.count("*").alias("n"), F.count_if(flag("is_synthetic")).alias("synthetic"))
    edges = graph.edges.groupBy(kind.alias("type")).agg(F.count("*").alias("n"), F.count_if(primitive).alias("primitive"), F.count_if(F.col("type").isin(*S.DERIVED_TYPES) | flag("is_derived")).alias("derived"), F.count_if(unresolved).alias("unresolved"))

    def rows(table: DataFrame, prefix: str, totals: dict[str, str]) -> DataFrame:
        by_type = F.struct(F.concat(F.lit(prefix), "type").alias("statistic"), F.col("n").alias("value"))
        sums = [F.struct(F.lit(name).alias("statistic"), F.expr(value).alias("value")) for name, value in totals.items()]
        return table.select(F.explode(F.array(by_type, *sums)).alias("r")).select("r.*").groupBy("statistic").agg(F.sum("value").alias("value"))

    return rows(nodes, "nodes:", {"total_nodes": "n", "analyzer_entity_count": "n - synthetic", "synthetic_node_count": "synthetic"}).union(
        rows(edges, "edges:", {"total_edges": "n", "primitive_relationship_count": "primitive", "derived_relationship_count": "derived", "unresolved_calls_count": "unresolved"})
    )


def get_statistics(graph: PropertyGraph) -> dict[str, Any]:
    """Totals, and counts by type with sorted keys."""
    rows = {r.statistic: r.value for r in statistics_table(graph).collect()}  # a row a type
    by = lambda prefix: {k.removeprefix(prefix): v for k, v in sorted(rows.items()) if k.startswith(prefix)}
    totals = ("total_nodes", "total_edges", "analyzer_entity_count", "synthetic_node_count", "primitive_relationship_count", "derived_relationship_count", "unresolved_calls_count")
    return {**{k: rows.get(k, 0) for k in totals}, "entities_by_type": by("nodes:"), "relationships_by_type": by("edges:")}


def get_structural_context(graph: PropertyGraph, entity_id: str, depth: int = 1, rel_types=None, include_unresolved: bool = False):
    from .traverse import expand_context

    return expand_context(graph, entity_id, depth, rel_types, "both", include_unresolved)
