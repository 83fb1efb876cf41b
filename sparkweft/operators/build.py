"""Graphs from entities and relationships, with placeholders for unresolved calls and one check of all rules."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lineage
from ..functions import schema as S
from ..functions.lineage import cut, dropped, kept, to_all
from ..functions.scalars import without_prefix
from .graph import PropertyGraph, dumps

ENTITIES = f"id string, type string, name string, path string, location {S.LOCATION}, properties string, ord long"
RELATIONSHIPS = f"id string, source string, target string, type string, location {S.LOCATION}, properties string, ord long"
PASSES = 4  # at most, over parts of the keys, so that a pass shuffles a part of them
_ERRORS = {e.__name__: e for e in (S.KnowledgeGraphError, S.NodeNotFoundError, S.NodeAlreadyExistsError, S.RelationshipAlreadyExistsError, S.InvalidNodeTypeError, S.InvalidRelationshipTypeError, ValueError)}


def _is(json_column: Column, key: str, value: str) -> Column:
    """Whether the JSON object has exactly this value under the key (a null object hasn't)."""
    return F.coalesce(F.get_json_object(json_column, f"$.{key}") == value, F.lit(False))


def is_false(json_column: Column, key: str) -> Column:
    """Whether the value is the boolean false: not 0, "false" or null."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json_column), f"$.{key}", "variant"))
    return _is(json_column, key, "false") & (kind == "BOOLEAN")  # few need the second look


def is_truthy(json_column: Column, key: str) -> Column:
    """Whether the value is there and is neither false, null, zero nor empty."""
    value = F.get_json_object(json_column, f"$.{key}")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json_column), f"$.{key}", "variant"))
    nothing = value.isin("false", "", "[]", "{}") & (kind != "STRING") | (value == "") | F.coalesce(value.try_cast("double") == 0, F.lit(False)) & (kind != "STRING")
    return F.coalesce(value.isNotNull() & ~nothing, F.lit(False))


def flagged(relationships: DataFrame) -> DataFrame:
    """relationships with is_derived, is_primitive and is_unresolved, from their types as given."""
    derived = is_truthy(F.col("properties"), "derived") | F.col("type").isin(*S.DERIVED_TYPES)
    return relationships.withColumns({
        "is_derived": F.coalesce(derived, F.lit(False)),
        "is_primitive": F.coalesce(~derived & F.col("type").isin(*S.PRIMITIVE_TYPES), F.lit(False)),
        "is_unresolved": F.coalesce(F.startswith("target", F.lit("unresolved:")), F.lit(False)) | F.coalesce(is_false(F.col("properties"), "resolved"), F.lit(False)),
    })


def with_entity_flags(entities: DataFrame) -> DataFrame:
    """entities with is_analyzer_entity and is_synthetic."""
    return entities.withColumns({
        "is_analyzer_entity": F.coalesce(F.col("type").isin(*S.ENTITY_TYPES), F.lit(False)),
        "is_synthetic": F.coalesce(F.col("type") == S.PLACEHOLDER, F.lit(False)) | is_truthy(F.col("properties"), "is_synthetic"),
    })


def _judged(rows: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """rows with `fresh` (the first of its keys) and `same` (equal to that first one in the values): one shuffle, and none where rows lie by one of the keys."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    print_ = F.struct(*values)
    first = F.first(F.struct(F.col(order).alias("o"), print_.alias("v"))).over(so_far)
    return rows.withColumn("_first", first).withColumn("fresh", F.col(order) == F.col("_first.o")).withColumn("same", print_.eqNullSafe(F.col("_first.v"))).drop("_first")


def _typed_entities(entities: DataFrame) -> DataFrame:
    return entities.withColumn("_type", S.normalised(F.col("type"), S.NODE_LOOKUP))


def _typed_relationships(relationships: DataFrame) -> DataFrame:
    return relationships.withColumn("_type", S.normalised(F.col("type"), S.RELATIONSHIP_LOOKUP)).withColumn("_key", F.coalesce("id", "_type"))


def _judged_entities(entities: DataFrame) -> DataFrame:
    return _judged(_typed_entities(entities), ["id"], ["_type", "name", "path", "location", "properties"], "ord")


def _judged_relationships(relationships: DataFrame, ids: DataFrame, made: DataFrame) -> DataFrame:
    """relationships with what there is of their ends (ids of entities; made: placeholders), and whether they repeat others."""
    # A node is there from its entity on, a placeholder from its first unresolved relationship on.
    there = ids.select("id", F.lit(-1).cast("long").alias("since")).union(made.select("target", "ord"))
    sources, targets = there.toDF("source", "source_since"), there.toDF("target", "target_since")
    # By target first, so that rows lie by source for what follows.
    known = relationships.join(targets, "target", "left").join(sources, "source", "left")
    return _judged(_typed_relationships(known), ["source", "target", "_key"], ["_type", "location", "properties"], "ord")


def placeholders(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Nodes for unresolved targets that are no entity, with what the first relationship to each says (B6)."""
    missing = relationships.where("is_unresolved").join(entities.select(F.col("id").alias("target")).distinct(), "target", "left_anti")
    first = missing.groupBy("target").agg(F.min("ord").alias("ord"), F.min_by("properties", "ord").alias("properties"))
    raw = F.coalesce(F.nullif(F.get_json_object("properties", "$.raw_call"), F.lit("")), without_prefix("target"))
    return first.select("target", raw.alias("raw_call"), "properties", "ord")


def violations(entities: DataFrame, relationships: DataFrame, strict_duplicates: bool = False) -> DataFrame:
    """What breaks a rule: phase, ord, rank, error, message. The first in this order is the one raised."""
    nodes = _judged_entities(entities)
    ids = entities.select("id").distinct()
    return _faults(nodes, _judged_relationships(relationships, ids, placeholders(entities, relationships)), strict_duplicates)


def _blank(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit(""))) == ""


def _faults(nodes: DataFrame, edges: DataFrame, strict_duplicates: bool) -> DataFrame:
    fault = lambda rank, error, message: F.struct(F.lit(rank).alias("rank"), F.lit(error).alias("error"), message.alias("message"))
    quoted = lambda c: F.concat(F.lit("'"), F.coalesce(F.col(c), F.lit("None")), F.lit("'"))
    of_node = (
        F.when(F.col("type") == "Module", fault(0, "KnowledgeGraphError", F.concat(F.lit("Invalid entity "), quoted("id"), F.lit(": Module entities are deprecated in v2.0; module_name must be a property on File."))))
        .when(_blank("id") | _blank("name"), fault(1, "ValueError", F.concat(F.lit("A node's id and name must not be blank: "), quoted("id"))))
        .when(F.col("_type").isNull(), fault(2, "InvalidNodeTypeError", F.concat(F.lit("Invalid node type "), quoted("type"))))
        .when(~F.col("same"), fault(3, "NodeAlreadyExistsError", F.concat(F.lit("Node "), quoted("id"), F.lit(" already exists with other values."))))
        .when(~F.col("fresh") & F.lit(strict_duplicates), fault(4, "NodeAlreadyExistsError", F.concat(F.lit("Node "), quoted("id"), F.lit(" already exists."))))
    )
    named = F.concat(F.lit("Cannot create relationship '"), F.coalesce("id", "type"), F.lit("': "))
    of_edge = (
        F.when(F.col("source_since").isNull() | (F.col("source_since") >= F.col("ord")), fault(0, "NodeNotFoundError", F.concat(named, F.lit("Source entity "), quoted("source"), F.lit(" does not exist in graph."))))
        .when(~F.col("is_unresolved") & (F.col("target_since").isNull() | (F.col("target_since") >= F.col("ord"))), fault(1, "NodeNotFoundError", F.concat(named, F.lit("Target entity "), quoted("target"), F.lit(" does not exist in graph."))))
        .when(F.col("_type").isNull(), fault(2, "InvalidRelationshipTypeError", F.concat(F.lit("Invalid relationship type "), quoted("type"))))
        .when(~F.col("same"), fault(3, "RelationshipAlreadyExistsError", F.concat(F.lit("Relationship "), quoted("id"), F.lit(" already exists with other values."))))
    )
    found = lambda rows, phase, of: rows.select(F.lit(phase).alias("phase"), "ord", of.alias("f")).where("f IS NOT NULL")
    return found(nodes, 0, of_node).union(found(edges, 1, of_edge)).select("phase", "ord", "f.*")


def _passes(rows: DataFrame, n: int, key: str, found) -> DataFrame:
    """What found makes of the n rows, kept, from one part of them by their key after another."""
    passes = max(1, min(PASSES, -(-n // lineage.AT_ONCE)))
    out = None
    for i in range(passes):
        part = kept(found(rows.where(F.pmod(F.xxhash64(key), F.lit(passes)) == i)))
        out = part if out is None else out.union(part)
    return out


def _marked(rows: DataFrame, key: str, keys: DataFrame, n: int, mark: str) -> DataFrame:
    """rows with the mark, true where their key is one of the n distinct keys, else null."""
    return rows.join(to_all(keys.toDF(key).withColumn(mark, F.lit(True)), n), key, "left")


def _judged_apart(entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """Entities and relationships that are fresh and break no rule, then those in doubt, judged; placeholders; the entities' last place.

    In doubt is what another row may repeat, what may lack an end, and what looks wrong by itself. Only identifiers
    are kept and compared to find it, so tables without such rows are neither shuffled nor stored with all they hold.
    """
    entities, relationships = _typed_entities(entities), _typed_relationships(relationships)
    wrong_node = F.coalesce((F.col("type") == "Module") | _blank("id") | _blank("name") | F.col("_type").isNull() | F.col("ord").isNull(), F.lit(True))
    wrong_edge = F.coalesce(F.col("source").isNull() | F.col("target").isNull() | F.col("_type").isNull() | F.col("ord").isNull() | (F.col("ord") < 0), F.lit(True))
    noted = Observation()
    ids = kept(entities.observe(noted, F.max("ord").alias("last")).select("id", wrong_node.alias("wrong")))
    open_ = lambda c: F.when(F.col("is_unresolved"), F.col(c)).alias(c)
    ends = kept(relationships.select("source", "target", "is_unresolved", open_("ord"), open_("properties"), wrong_edge.alias("wrong")))
    n_ids, n_ends = ids.count(), ends.count()
    made = kept(placeholders(ids, ends))

    # Each identifier with the number of its entities; ends that are only looked for count as none.
    needed = ends.select(F.explode(F.array("source", F.when(~F.col("is_unresolved"), F.col("target")))).alias("id")).where("id IS NOT NULL")
    each = ids.select("id", F.lit(1).alias("n")).union(needed.withColumn("n", F.lit(0)))
    odd = _passes(each, n_ids + 2 * n_ends, "id", lambda part: part.groupBy("id").agg(F.sum("n").alias("n")).where("n <> 1"))
    again, lost = odd.where("n > 1").select("id"), odd.where("n = 0").select("id")
    # Pairs by a hash: one too many only means that its rows are judged.
    pairs = ends.select(F.xxhash64("source", "target").alias("_pair"))
    twice = _passes(pairs, n_ends, "_pair", lambda part: part.repartition("_pair").groupBy("_pair").agg(F.count("*").alias("n")).where("n > 1").select("_pair"))
    n_again, n_lost, n_twice = again.count(), lost.count(), twice.count()

    judged_nodes = judged_edges = None
    if n_again or not ids.where("wrong").isEmpty():
        doubt = F.coalesce("_again", F.lit(False)) | wrong_node
        marked = _marked(entities, "id", again, n_again, "_again").select(*entities.columns, doubt.alias("_doubt"))
        judged_nodes = kept(_judged_entities(marked.where("_doubt").drop("_doubt", "_type")))
        entities = marked.where("NOT _doubt").drop("_doubt")
    if n_lost or n_twice or not ends.where("wrong").isEmpty():
        doubt = F.coalesce("_twice", F.lit(False)) | F.coalesce("_source", F.lit(False)) | F.coalesce(F.col("_target") & ~F.col("is_unresolved"), F.lit(False)) | wrong_edge
        marked = _marked(relationships.withColumn("_pair", F.xxhash64("source", "target")), "_pair", twice, n_twice, "_twice")
        marked = _marked(_marked(marked, "source", lost, n_lost, "_source"), "target", lost, n_lost, "_target").select(*relationships.columns, doubt.alias("_doubt"))
        doubted = kept(marked.where("_doubt").drop("_doubt", "_type", "_key"))
        theirs = kept(doubted.select(F.explode(F.array("source", "target")).alias("id")).distinct())
        there = ids.select("id").join(to_all(theirs, theirs.count()), "id", "left_semi").distinct()
        judged_edges = kept(_judged_relationships(doubted, there, made))
        relationships = marked.where("NOT _doubt").drop("_doubt")
    dropped(ids)
    dropped(ends)
    return entities, relationships, judged_nodes, judged_edges, made, noted.get["last"] or 0


def from_tables(entities: DataFrame, relationships: DataFrame, metadata: dict[str, Any] | None = None, strict_duplicates: bool = False, on_missing: str = "error", check: bool = True) -> PropertyGraph:
    """The graph of entities and relationships (columns of ENTITIES and RELATIONSHIPS).

    One job looks for broken rules and raises the first. on_missing says what becomes of a relationship
    to a target that neither exists nor is marked unresolved: an error, a placeholder, or nothing (drop).
    The graph is a plan over the tables, which are read once to be judged and again with the graph.
    """
    if on_missing not in ("error", "placeholder", "drop"):
        raise ValueError(f"on_missing is 'error', 'placeholder' or 'drop', not {on_missing!r}")
    relationships = flagged(relationships)
    if on_missing != "error":
        ids = entities.select(F.col("id").alias("target")).distinct()
        dangling = relationships.where("NOT is_unresolved").join(ids, "target", "left_anti")
        sound = relationships.join(dangling.select("ord"), "ord", "left_anti")
        relationships = sound if on_missing == "drop" else sound.unionByName(dangling.withColumn("is_unresolved", F.lit(True)).select(*sound.columns))
    entities, relationships, judged, edges, made, last = _judged_apart(entities, relationships)
    if judged is None:
        judged = entities.withColumns({"fresh": F.lit(True), "same": F.lit(True)}).limit(0)
    if edges is None:
        nowhere = F.lit(None).cast("long")
        edges = relationships.withColumns({"source_since": nowhere, "target_since": nowhere, "fresh": F.lit(True), "same": F.lit(True)}).limit(0)
    if check:
        first = _faults(judged, edges, strict_duplicates).orderBy("phase", "ord", "rank").head()
        if first:
            raise _ERRORS[first.error](first.message)
    nothing = F.lit(None).cast("string")
    nodes = entities.unionByName(judged.where("fresh").select(*entities.columns)).select(
        "id", F.col("_type").alias("type"), "name", "path", "location", "properties",
        F.lit(False).alias("is_synthetic"), F.lit(True).alias("resolved"), nothing.alias("raw_call"), nothing.alias("extra"), F.col("ord").alias("node_ord"),
    )
    placed = made.select(
        F.col("target").alias("id"), F.lit(S.PLACEHOLDER).alias("type"), F.col("raw_call").alias("name"), nothing.alias("path"), F.lit(None).cast(S.LOCATION).alias("location"), "properties",
        F.lit(True).alias("is_synthetic"), F.lit(False).alias("resolved"), "raw_call", nothing.alias("extra"), (F.lit(last + 1) + F.col("ord")).alias("node_ord"),
    )
    kept_edges = relationships.unionByName(edges.where("fresh").select(*relationships.columns)).select(
        "source", "target", F.col("_key").alias("key"), "id", F.col("_type").alias("type"), "location", "properties", "is_derived", "is_primitive", "is_unresolved", nothing.alias("extra"), F.col("ord").alias("edge_ord"),
    )
    return PropertyGraph(nodes.unionByName(placed), kept_edges, metadata or {})


def _loaded(data: dict | str | Path) -> dict:
    if isinstance(data, (str, Path)):
        text = str(data)
        if text.lstrip()[:1] not in ("{", "["):  # a path; JSON may be too long to ask the file system about
            path = Path(text)
            if not path.is_file():
                raise FileNotFoundError(f"Analysis file not found: {path}")
            text = path.read_text(encoding="utf-8")
        data = json.loads(text)
    if not isinstance(data, dict):
        raise TypeError(f"An analysis is a dict, JSON text or a path, not {type(data).__name__}")
    return data


def _text(row: dict, key: str, optional: bool = False) -> str | None:
    value = row.get(key)
    if not isinstance(value, str) and not (optional and value is None):
        raise ValueError(f"{key} must be a string, not {value!r}")
    return value


def _location(row: dict) -> tuple | None:
    at = row.get("location")
    number = lambda v: None if v is None else int(float(v)) if float(v) == int(float(v)) else _fail(v)
    return at and (at.get("file"), *(number(at.get(k)) for k in ("start_line", "end_line", "start_column", "end_column")))


def _fail(value: object):
    raise ValueError(f"a whole number is expected, not {value!r}")


def tables(spark: SparkSession, data: dict) -> tuple[DataFrame, DataFrame]:
    """The entities and relationships of one analysis document, in its order."""
    entities = [(_text(e, "id"), _text(e, "type"), _text(e, "name"), _text(e, "path", True), _location(e), dumps(e.get("properties") or {}), i) for i, e in enumerate(data.get("entities") or [])]
    rels = [(_text(r, "id", True), _text(r, "source"), _text(r, "target"), _text(r, "type"), _location(r), dumps(r.get("properties") or {}), i) for i, r in enumerate(data.get("relationships") or [])]
    return spark.createDataFrame(entities, ENTITIES), spark.createDataFrame(rels, RELATIONSHIPS)


def build_from_analysis(spark: SparkSession, data: dict | str | Path, strict_duplicates: bool = False, on_missing: str = "error") -> PropertyGraph:
    """The graph of one analysis document: a dict, JSON text or the path of a file."""
    loaded = _loaded(data)
    return from_tables(*tables(spark, loaded), dict(loaded.get("metadata") or {}), strict_duplicates, on_missing)


def build_from_file(spark: SparkSession, path: str | Path, **options: Any) -> PropertyGraph:
    if not Path(path).is_file():
        raise FileNotFoundError(f"Analysis file not found: {path}")
    return build_from_analysis(spark, Path(path), **options)


def upsert(graph: PropertyGraph, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> PropertyGraph:
    """The graph with tables of nodes and edges (columns of NODES and EDGES) merged in.

    Rows that are there already must not differ in what both have; what only the new one has fills the
    gaps. An edge's ends must exist. A difference or a missing end is an error, found by one job each.
    """
    merged_nodes, merged_edges = graph.nodes, graph.edges
    if nodes is not None:
        merged_nodes = _merged(graph.nodes, nodes, ["id"], "node_ord", S.NodeAlreadyExistsError)
    if edges is not None:
        for end in ("source", "target"):
            lost = edges.join(merged_nodes.select(F.col("id").alias(end)), end, "left_anti").select(end).head()
            if lost:
                raise S.NodeNotFoundError(f"{end.capitalize()} node '{lost[0]}' does not exist in graph.")
        merged_edges = _merged(graph.edges, edges, ["source", "target", "key"], "edge_ord", S.RelationshipAlreadyExistsError)
    return PropertyGraph(merged_nodes, merged_edges, graph.metadata)


def _merged(old: DataFrame, new: DataFrame, keys: list[str], order: str, error: type[Exception]) -> DataFrame:
    values = [c for c in old.columns if c not in (*keys, order)]
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    place = F.struct("_age", order)
    grouped = both.groupBy(*keys).agg(
        *(F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in values),
        *((F.min(F.col(c).cast("string")).alias(f"_a_{c}")) for c in values),
        *((F.max(F.col(c).cast("string")).alias(f"_b_{c}")) for c in values),
        F.min_by(order, place).alias(order),
    )
    grouped = cut(grouped)
    clash = [F.col(f"_a_{c}") != F.col(f"_b_{c}") for c in values]
    found = grouped.where(F.coalesce(F.greatest(*(x.cast("int") for x in clash)), F.lit(0)) > 0).select(*keys).head()
    if found:
        raise error(f"{' -> '.join(found)} already exists with other values.")
    return grouped.select(*old.columns)


def merged_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each of the keys: of every column the value of the first row that has one."""
    values = [c for c in rows.columns if c not in (*keys, order)]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values]
    return rows.groupBy(*keys).agg(*first, F.min(order).alias(order)).select(*rows.columns)
