"""The integrity rules of a graph, as one table of issues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.lineage import kept, to_all
from .graph import PropertyGraph
from .query import missing_ends


@dataclass(frozen=True)
class ValidationReport:
    issues: DataFrame
    error_count: int
    warning_count: int

    @property
    def is_valid(self) -> bool:
        return self.error_count == 0

    def summary(self) -> str:
        return f"Validation {'PASSED' if self.is_valid else 'FAILED'}: {self.error_count} error(s), {self.warning_count} warning(s)."


def _issues(table: DataFrame, element, rules: list[tuple]) -> DataFrame:
    """A row for each rule (level, category, message, condition) that an element breaks."""
    found = [F.when(condition, F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), message.alias("message"))) for level, category, message, condition in rules]
    return table.select(element.alias("element_id"), F.explode(F.array_compact(F.array(*found))).alias("i")).select("i.level", "i.category", "i.message", "element_id")


def validation_issues(graph: PropertyGraph) -> DataFrame:
    """(level, category, message, element_id) of everything that breaks a rule."""
    text = lambda *parts: F.concat(*(F.coalesce(F.col(p[1:]), F.lit("None")) if p.startswith("$") else F.lit(p) for p in parts))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = S.normalised(F.col("type"), S.NODE_LOOKUP)
    known, synthetic = kind.isNotNull(), flag("is_synthetic")
    nodes = _issues(graph.nodes, F.col("id"), [
        ("ERROR", "node_id", text("Node id is empty."), blank("id")),
        ("ERROR", "node_name", text("Node '", "$id", "' has no name."), blank("name")),
        ("ERROR", "node_type", text("Node '", "$id", "' has invalid type '", "$type", "'."), ~known),
        ("ERROR", "entity_type", text("Node '", "$id", "' has type '", "$type", "', which no entity has."), known & ~synthetic & ~kind.isin(*S.ENTITY_TYPES)),
        ("ERROR", "module_entity", text("Node '", "$id", "' is a Module; module_name is a property of files."), known & ~synthetic & (kind == "Module")),
        ("ERROR", "synthetic_node", text("Synthetic node '", "$id", "' has type '", "$type", "'."), known & synthetic & (kind != S.PLACEHOLDER)),
        ("WARNING", "synthetic_node", text("Synthetic node '", "$id", "' is not marked unresolved."), known & synthetic & ~F.coalesce(F.col("resolved") == False, F.lit(False))),  # noqa: E712
    ])
    rel = S.normalised(F.col("type"), S.RELATIONSHIP_LOOKUP)
    unresolved = flag("is_unresolved") | F.startswith("target", F.lit("unresolved:"))
    # Few edges lack an end, and few nodes are targets of unresolved calls: edges stay where they are.
    lost = missing_ends(graph.edges, graph.nodes.select("id"))
    called = kept(graph.edges.where((rel == "CALLS") & unresolved).select(F.col("target").alias("id")).distinct())
    real = kept(graph.nodes.select("id", flag("is_synthetic").alias("syn")).join(to_all(called, called.count()), "id", "left_semi").groupBy("id").agg(F.max("syn").alias("syn")).where("NOT syn"))
    m = lost.count()
    no = lambda end: to_all(lost.select(F.col("id").alias(end), F.lit(True).alias(f"no_{end}")), m)
    edges = graph.edges.join(no("source"), "source", "left").join(no("target"), "target", "left").join(to_all(real.select(F.col("id").alias("target"), F.lit(True).alias("target_real")), real.count()), "target", "left")
    return nodes.union(_issues(edges, F.coalesce("id", "key"), [
        ("ERROR", "missing_source", text("Source '", "$source", "' does not exist."), flag("no_source") | F.col("source").isNull()),
        ("ERROR", "missing_target", text("Target '", "$target", "' does not exist."), flag("no_target") | F.col("target").isNull()),
        ("ERROR", "relationship_type", text("Relationship type '", "$type", "' is invalid."), rel.isNull()),
        ("WARNING", "deprecated_relationship", text("Relationship type DEFINED_IN is deprecated."), F.coalesce(rel == "DEFINED_IN", F.lit(False))),
        ("ERROR", "unresolved_reference", text("Unresolved call's target '", "$target", "' is not synthetic."), F.coalesce((rel == "CALLS") & unresolved & F.col("target_real"), F.lit(False))),
    ]))


def validate_graph(graph: PropertyGraph) -> ValidationReport:
    issues = validation_issues(graph)
    counts = {r.level: r["count"] for r in issues.groupBy("level").count().collect()}
    return ValidationReport(issues, counts.get("ERROR", 0), counts.get("WARNING", 0))


def validate_or_raise(graph: PropertyGraph, shown: int = 20) -> ValidationReport:
    """The report, or an error that lists the first `shown` errors and how many there are."""
    report = validate_graph(graph)
    if not report.is_valid:
        rows = report.issues.where("level = 'ERROR'").orderBy("category", "message").limit(shown).collect()
        raise S.KnowledgeGraphError(f"Graph validation failed with {report.error_count} error(s):\n" + "\n".join(f"- [{r.category}] {r.message}" for r in rows))
    return report
