"""A directed typed multigraph as two tables. Graphs don't change; what adds to one returns another."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.lineage import cut

_NODE_COLUMNS = ("id", "type", "name", "path", "location", "properties", "is_synthetic", "resolved", "raw_call")
_EDGE_COLUMNS = ("source", "target", "key", "id", "type", "location", "properties", "is_derived", "is_primitive", "is_unresolved")


def dumps(value: Any) -> str | None:
    """Canonical JSON: sorted keys, no spaces."""
    return None if value is None else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def attributes(row: Row, columns: tuple[str, ...]) -> dict[str, Any]:
    """A node or edge as a dict: what is not null, with properties and further attributes decoded."""
    found = {c: row[c] for c in columns if row[c] is not None}
    if "location" in found:
        found["location"] = found["location"].asDict()
    if "properties" in found:
        found["properties"] = json.loads(found["properties"])
    return found | (json.loads(row["extra"]) if row["extra"] else {})


def _columns(given: dict[str, Any], columns: tuple[str, ...]) -> dict[str, Any]:
    """The table's columns of a dict; attributes without a column go in extra."""
    out = {c: given.get(c) for c in columns}
    out["properties"] = dumps(out["properties"])
    extra = {k: v for k, v in given.items() if k not in columns}
    return out | {"extra": dumps(extra) if extra else None}


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame
    metadata: dict[str, Any] = field(default_factory=dict)

    @staticmethod
    def empty(spark: SparkSession, metadata: dict[str, Any] | None = None) -> PropertyGraph:
        return PropertyGraph(spark.createDataFrame([], S.NODES), spark.createDataFrame([], S.EDGES), metadata or {})

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def persist(self) -> PropertyGraph:
        return PropertyGraph(self.nodes.persist(), self.edges.persist(), self.metadata)

    def kept(self) -> PropertyGraph:
        """The graph computed once and kept in the shared folder, for plans that read it again and again."""
        return PropertyGraph(cut(self.nodes), cut(self.edges), self.metadata)

    def clear(self) -> PropertyGraph:
        """No nodes and edges; the metadata stays."""
        return PropertyGraph.empty(self.spark, dict(self.metadata))

    # Lookups.

    def number_of_nodes(self) -> int:
        return self.nodes.count()

    def number_of_edges(self) -> int:
        return self.edges.count()

    def has_node(self, node_id: object) -> bool:
        return isinstance(node_id, str) and not self.nodes.where(F.col("id") == node_id).isEmpty()

    def get_node(self, node_id: str) -> dict[str, Any] | None:
        row = self.nodes.where(F.col("id") == node_id).head()
        return row and attributes(row, _NODE_COLUMNS)

    def get_all_nodes(self) -> DataFrame:
        return self.nodes

    def between(self, source: str, target: str) -> DataFrame:
        return self.edges.where((F.col("source") == source) & (F.col("target") == target))

    def has_relationship(self, source: str, target: str, rel_type: str | None = None) -> bool:
        found = self.between(source, target)
        if rel_type is None:
            return not found.isEmpty()
        if found.isEmpty():
            return False  # and the type may be anything
        return not found.where(F.col("type") == S.relationship_type(rel_type)).isEmpty()

    def get_relationship(self, source: str, target: str, rel_type: str, key: str | None = None) -> dict[str, Any] | None:
        """The edge with the key, whatever its type, or the first of the type."""
        found = self.between(source, target)
        chosen = found.where(F.col("key") == key) if key is not None else found.where(F.col("type") == S.relationship_type(rel_type))
        row = chosen.orderBy("edge_ord").head()
        return row and attributes(row, _EDGE_COLUMNS)

    def get_relationships(self, source: str, target: str) -> DataFrame:
        return self.between(source, target)

    def get_all_relationships(self) -> DataFrame:
        """Edges by their source's place, then the target's first one from there, then their own."""
        from pyspark.sql import Window

        place = self.nodes.select(F.col("id").alias("source"), "node_ord")
        first = F.min("edge_ord").over(Window.partitionBy("source", "target"))
        return self.edges.join(place, "source").withColumn("_first", first).orderBy("node_ord", "_first", "edge_ord").select(*self.edges.columns)

    # Additions, one at a time. Tables of nodes and edges come in through build.from_tables.

    def _next(self, table: DataFrame, column: str) -> int:
        return (table.agg(F.max(column)).first()[0] or 0) + 1

    def _with(self, table: DataFrame, schema: str, row: dict[str, Any], same) -> DataFrame:
        names = [f.split()[0] for f in schema.replace(S.LOCATION, "location_type").split(", ")]
        return table.where(~same).unionByName(self.spark.createDataFrame([tuple(row.get(n) for n in names)], schema))

    def add_node(self, node_id: str, node_type: str, name: str, raise_if_exists: bool = True, **meta: Any) -> PropertyGraph:
        """The graph with the node. An existing one must not differ in a shared attribute; new ones are added to it."""
        for label, value in (("id", node_id), ("name", name)):
            if not isinstance(value, str) or not value.strip():
                raise ValueError(f"A node's {label} must be a string that is not blank, not {value!r}.")
        given = {"id": node_id, "type": S.node_type(node_type), "name": name, **meta}
        row = self.nodes.where(F.col("id") == node_id).head()
        place = row["node_ord"] if row else self._next(self.nodes, "node_ord")
        if row:
            old = attributes(row, _NODE_COLUMNS)
            changed = sorted(k for k in given if k in old and old[k] != given[k])
            if changed:
                raise NodeExists(f"Node '{node_id}' already exists with other values of {', '.join(changed)}.")
            if raise_if_exists:
                raise NodeExists(f"Node '{node_id}' already exists.")
            given = {**given, **old}
        new = self._with(self.nodes, S.NODES, _columns(given, _NODE_COLUMNS) | {"node_ord": place}, F.col("id") == node_id)
        return PropertyGraph(new, self.edges, self.metadata)

    def add_relationship(self, source: str, target: str, rel_type: str, key: str | None = None, raise_if_exists: bool = False, **meta: Any) -> PropertyGraph:
        """The graph with the edge; both ends must exist. Its key is the one given, else its id, else its type."""
        for label, end in (("Source", source), ("Target", target)):
            if not self.has_node(end):
                raise S.NodeNotFoundError(f"{label} node '{end}' does not exist in graph.")
        kind = S.relationship_type(rel_type)
        key = key if key is not None else meta.get("id") or kind
        given = {"source": source, "target": target, "key": key, "type": kind, **meta}
        same = (F.col("source") == source) & (F.col("target") == target) & (F.col("key") == key)
        row = self.edges.where(same).head()
        place = row["edge_ord"] if row else self._next(self.edges, "edge_ord")
        if row:
            old = attributes(row, _EDGE_COLUMNS)
            changed = sorted(k for k in given if k in old and old[k] != given[k])
            if changed or raise_if_exists:
                raise S.RelationshipAlreadyExistsError(f"Relationship '{source}' -> '{target}' ({key}) already exists" + (f" with other values of {', '.join(changed)}." if changed else "."))
            given = {**given, **old}
        new = self._with(self.edges, S.EDGES, _columns(given, _EDGE_COLUMNS) | {"edge_ord": place}, same)
        return PropertyGraph(self.nodes, new, self.metadata)


NodeExists = S.NodeAlreadyExistsError
KnowledgeGraph = PropertyGraph
