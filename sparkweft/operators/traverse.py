"""Neighbours, shortest paths and multi-hop contexts, level by level over tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.lineage import LISTED, SENT, few, kept, to_all
from .graph import PropertyGraph
from .query import induced

DIRECTIONS = ("in", "out", "both")
DEPENDENCY_TYPES = ("DEPENDS_ON", "IMPORTS")


def _steps(graph: PropertyGraph, rel_types, direction: str) -> DataFrame:
    """Edges as steps (at, to) in the direction, of the types."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}, not {direction!r}")
    types = S.relationship_types(rel_types)
    edges = graph.edges if types is None else graph.edges.where(F.col("type").isin(types))
    out = edges.select(F.col("source").alias("at"), F.col("target").alias("to"))
    back = edges.select(F.col("target").alias("at"), F.col("source").alias("to"))
    return out if direction == "out" else back if direction == "in" else out.union(back)


def _exists(graph: PropertyGraph, *ids: str) -> None:
    found = {r.id for r in graph.nodes.where(F.col("id").isin(*ids)).select("id").distinct().collect()}
    for i in ids:
        if i not in found:
            raise S.NodeNotFoundError(f"Node '{i}' does not exist in graph.")


def get_neighbors(graph: PropertyGraph, node_id: str, direction: str = "both", rel_types=None) -> DataFrame:
    """(id) of the distinct neighbours, sorted; no type matches an empty list, and all match None."""
    _exists(graph, node_id)
    return _steps(graph, rel_types, direction).where(F.col("at") == node_id).select(F.col("to").alias("id")).distinct().orderBy("id")


def get_callers(graph: PropertyGraph, node_id: str) -> DataFrame:
    return get_neighbors(graph, node_id, "in", ["CALLS"])


def get_callees(graph: PropertyGraph, node_id: str, include_unresolved: bool = True) -> DataFrame:
    found = get_neighbors(graph, node_id, "out", ["CALLS"])
    return found if include_unresolved else found.join(graph.nodes.where("is_synthetic").select("id"), "id", "left_anti").orderBy("id")


def get_dependencies(graph: PropertyGraph, node_id: str, rel_types=None) -> DataFrame:
    """What the node depends on; without types, or with none, by DEPENDS_ON and IMPORTS."""
    return get_neighbors(graph, node_id, "out", rel_types or DEPENDENCY_TYPES)


def get_dependents(graph: PropertyGraph, node_id: str, rel_types=None) -> DataFrame:
    return get_neighbors(graph, node_id, "in", rel_types or DEPENDENCY_TYPES)


def _after(front: DataFrame, n: int, steps: DataFrame) -> DataFrame:
    """front's n rows with `to`, where the steps lead from their ids; few ids narrow the steps down before anything is shuffled."""
    at = front.select(F.col("id").alias("at")).distinct()
    listed = few(at, "at", LISTED)
    if listed is not None:
        steps = steps.where(F.col("at").isin(listed))
    else:  # a join that only filters goes below the shuffles that make the steps
        at = kept(at)
        m = at.count()
        if m <= SENT or n > SENT:
            steps = steps.join(to_all(at, m), "at", "left_semi")
    return to_all(front, n).join(steps, F.col("id") == F.col("at")).drop("id", "at")


def _starts(steps: DataFrame) -> tuple[DataFrame, int]:
    """(id) of what any of the steps begins at, and how many."""
    found = kept(steps.select(F.col("at").alias("id")).distinct())
    return found, found.count()


def _unresolved(graph: PropertyGraph) -> tuple[DataFrame, int]:
    """(id) of the placeholders, and how many."""
    found = kept(graph.nodes.where("is_synthetic").select("id"))
    return found, found.count()


def hops(graph: PropertyGraph, seeds: DataFrame, max_hops: int = 2, rel_types=None, direction: str = "both", include_unresolved: bool = True, enough: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """(seed, id, hop): every node within max_hops of each seed (column seed), with its least distance.

    Without unresolved nodes, placeholders are neither reached nor passed; a seed may be one. With
    enough, a seed goes no further than the hop within which it has so many nodes (of the ids in among, if given).
    """
    steps = _steps(graph, rel_types, direction)
    closed = None if include_unresolved else _unresolved(graph)
    seen = front = kept(seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hop")).distinct())
    n = total = seen.count()
    for hop in range(1, max_hops + 1):
        if enough is not None:
            counted = seen if among is None else seen.join(among.select("id"), "id", "left_semi")
            done = kept(counted.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("seed"))
            front = front.join(to_all(done, done.count()), "seed", "left_anti")
            n = front.count()
            if not n:
                break
        found = _after(front.select("seed", "id"), n, steps).select("seed", F.col("to").alias("id")).distinct()
        if closed:
            found = found.join(to_all(*closed), "id", "left_anti")
        front = kept(found.join(to_all(seen.select("seed", "id"), total), ["seed", "id"], "left_anti").select("seed", "id", F.lit(hop).alias("hop")))
        n = front.count()
        if not n:
            break
        seen, total = seen.union(front), total + n
    return seen


def reached(roots: DataFrame, steps: DataFrame, max_hops: int | None = None, closed: tuple[DataFrame, int] | None = None, starts: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(id, hop) of what steps (at, to) reach from any of the roots (id), with the distance of the nearest one.

    closed: ids, and how many, that are not reached; starts: those that any step begins at.
    """
    seen = front = kept(roots.select("id").distinct().withColumn("hop", F.lit(0)))
    n = total = seen.count()
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        if starts and n > LISTED:
            front = front.join(to_all(*starts), "id", "left_semi")
            n = front.count()
        found = _after(front.select("id"), n, steps).select(F.col("to").alias("id")).distinct()
        if closed:
            found = found.join(to_all(*closed), "id", "left_anti")
        front = kept(found.join(to_all(seen.select("id"), total), "id", "left_anti").withColumn("hop", F.lit(hop)))
        n = front.count()
        if not n:
            break
        seen, total = seen.union(front), total + n
    return seen


def _seeds(graph: PropertyGraph, seeds) -> tuple[list[str], DataFrame]:
    listed = [seeds] if isinstance(seeds, str) else list(seeds)
    if listed:
        _exists(graph, *listed)
    return listed, graph.spark.createDataFrame([(s,) for s in listed], "seed string")


def multi_hop_traversal(graph: PropertyGraph, seeds, max_hops: int = 2, rel_types=None, direction: str = "both", include_unresolved: bool = True) -> DataFrame:
    """(id, hop) of the nodes within max_hops of the nearest seed; the seeds themselves at hop 0."""
    _, rows = _seeds(graph, seeds)
    closed = None if include_unresolved else _unresolved(graph)
    return reached(rows.select(F.col("seed").alias("id")), _steps(graph, rel_types, direction), max_hops, closed)


@dataclass(frozen=True)
class Context:
    seed_ids: list[str]
    max_hops: int
    nodes: DataFrame
    edges: DataFrame
    hop_distances: DataFrame


def expand_context(graph: PropertyGraph, seeds, max_hops: int = 2, rel_types=None, direction: str = "both", include_unresolved: bool = False) -> Context:
    """The nodes around the seeds, sorted by id, with their distances and all edges of the types among them."""
    listed, _ = _seeds(graph, seeds)
    near = multi_hop_traversal(graph, listed, max_hops, rel_types, direction, include_unresolved)
    types = S.relationship_types(rel_types)
    edges = graph.edges if types is None else graph.edges.where(F.col("type").isin(types))
    n = near.count()
    return Context(listed, max_hops, graph.nodes.join(to_all(near.select("id"), n), "id", "left_semi").orderBy("id"), induced(edges, near.select("id"), n), near)


def shortest_paths(graph: PropertyGraph, source: str, rel_types=None, max_depth: int | None = None, target: str | None = None) -> DataFrame:
    """(id, depth, path) of the nodes that directed edges reach from the source, as far as the target if there is one.

    Of several shortest paths it is the one a queue finds: parents in the order in which they were
    reached, and each parent's neighbours in the order of their first edge.
    """
    types = S.relationship_types(rel_types)
    edges = graph.edges if types is None else graph.edges.where(F.col("type").isin(types))
    steps = edges.select(F.col("source").alias("at"), F.col("target").alias("to"), F.col("edge_ord").alias("place"))
    # A node's key in its level is its path's keys, so that levels need no numbering across all rows.
    front = seen = kept(graph.spark.createDataFrame([(source, 0, [source], [0])], "id string, depth int, path array<string>, keys array<long>"))
    depth, n, total, starts = 0, 1, 1, None
    while max_depth is None or depth < max_depth:
        depth += 1
        if n > SENT:  # few of many nodes may lead on
            starts = starts or _starts(steps)
            if starts[1] <= SENT:
                front = front.join(to_all(*starts), "id", "left_semi")
                n = front.count()
                if not n:
                    break
        carried = ["path"] if n > SENT else []  # else paths are looked up once each node's parent is known
        found = _after(front.select("id", "keys", F.col("id").alias("parent"), *carried), n, steps).select(F.col("to").alias("id"), F.concat("keys", F.array("place")).alias("keys"), "parent", *carried)
        best = found.join(to_all(seen.select("id"), total), "id", "left_anti").groupBy("id").agg(F.min(F.struct("keys", "parent", *carried)).alias("best")).select("id", "best.*")
        if not carried:
            best = best.join(to_all(front.select(F.col("id").alias("parent"), "path"), n), "parent")
        front = kept(best.select("id", F.lit(depth).alias("depth"), F.concat("path", F.array("id")).alias("path"), "keys"))
        n = front.count()
        if not n:
            break
        seen, total = seen.union(front), total + n
        if target is not None and not front.where(F.col("id") == target).isEmpty():
            break
    return seen.select("id", "depth", "path")


def find_path(graph: PropertyGraph, source: str, target: str, rel_types=None, max_depth: int | None = None) -> list[str] | None:
    """The ids on a shortest directed path, or None if there is none of at most max_depth edges."""
    _exists(graph, source, target)
    if source == target:
        return [source]
    row = shortest_paths(graph, source, rel_types, max_depth, target).where(F.col("id") == target).head()
    return row and list(row.path)
