"""Type domains, errors and table schemas of code graphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The type domains of the data model, by member name.
NODE_TYPES = {
    "REPOSITORY": "Repository", "DIRECTORY": "Directory", "FILE": "File", "MODULE": "Module",
    "CLASS": "Class", "FUNCTION": "Function", "METHOD": "Method", "UNRESOLVED_REFERENCE": "UnresolvedReference",
}
RELATIONSHIP_TYPES = {t: t for t in ("CONTAINS", "IMPORTS", "CALLS", "INHERITS", "DEFINED_IN", "DEPENDS_ON")}
ENTITY_TYPES = ("Repository", "Directory", "File", "Class", "Function", "Method")
PRIMITIVE_TYPES = ("CONTAINS", "IMPORTS", "CALLS", "INHERITS")
DERIVED_TYPES = ("DEPENDS_ON",)
PLACEHOLDER = "UnresolvedReference"

LOCATION = "struct<file:string,start_line:int,end_line:int,start_column:int,end_column:int>"
NODES = f"id string, type string, name string, path string, location {LOCATION}, properties string, is_synthetic boolean, resolved boolean, raw_call string, extra string, node_ord long"
EDGES = f"source string, target string, key string, id string, type string, location {LOCATION}, properties string, is_derived boolean, is_primitive boolean, is_unresolved boolean, extra string, edge_ord long"


class KnowledgeGraphError(Exception):
    """The base of all errors about a graph."""


class NodeNotFoundError(KnowledgeGraphError):
    pass


class NodeAlreadyExistsError(KnowledgeGraphError):
    pass


class RelationshipAlreadyExistsError(KnowledgeGraphError):
    pass


class InvalidNodeTypeError(KnowledgeGraphError, ValueError):
    pass


class InvalidRelationshipTypeError(KnowledgeGraphError, ValueError):
    pass


def _lookup(domain: dict[str, str]) -> dict[str, str]:
    """Lower-cased values and member names, each with the value that it stands for."""
    return {spelling.lower(): value for name, value in domain.items() for spelling in (name, value)}


NODE_LOOKUP, RELATIONSHIP_LOOKUP = _lookup(NODE_TYPES), _lookup(RELATIONSHIP_TYPES)


def node_type(value: object) -> str:
    """The node type that the text stands for, in any case, by value or member name."""
    found = NODE_LOOKUP.get(str(value).lower())
    if found is None:
        raise InvalidNodeTypeError(f"Invalid node type {value!r}; one of {sorted(NODE_TYPES.values())} is expected.")
    return found


def relationship_type(value: object) -> str:
    found = RELATIONSHIP_LOOKUP.get(str(value).lower())
    if found is None:
        raise InvalidRelationshipTypeError(f"Invalid relationship type {value!r}; one of {sorted(RELATIONSHIP_TYPES)} is expected.")
    return found


def relationship_types(values) -> list[str] | None:
    """The types of a filter: None for all, a list (an empty one matches nothing) otherwise."""
    if values is None:
        return None
    return sorted({relationship_type(v) for v in ([values] if isinstance(values, str) else values)})


def normalised(column: Column, lookup: dict[str, str]) -> Column:
    """node_type or relationship_type of a column; null where the text is in neither domain."""
    pairs = [F.lit(x) for pair in sorted(lookup.items()) for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(column))


def canonical(json: Column) -> Column:
    """JSON text with sorted keys, nulls kept, so that equal values have equal text."""
    return F.to_json(F.parse_json(json))
