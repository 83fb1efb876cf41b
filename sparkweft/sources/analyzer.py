"""A source tree analysed: entities, relationships, the envelope of both, and its hash."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import schema as S
from ..operators.build import flagged
from ..operators.depends import derive_depends_on_relationships
from .ast_facts import parse_files
from .repo_tree import read_tree
from .resolve import resolve, symbol_table

VERSION = "0.1.0"
_CERTAIN = '{"confidence":"certain"}'


def _json(**fields) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))), {"ignoreNullFields": "false"})


def _relation(kind: str, source, target, identifier, location, properties, order=None):
    """order: the place in the file, which equal identifiers keep."""
    return [identifier.alias("id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), location.cast(S.LOCATION).alias("location"), properties.alias("properties"), (F.lit(0) if order is None else order).cast("long").alias("ord")]


def _contains(source, target):
    return _relation("CONTAINS", source, target, F.concat(F.lit("rel:contains:"), source, F.lit("->"), target), F.lit(None), F.lit(_CERTAIN))


def _place(path, start, end, first, last):
    return F.struct(path.alias("file"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), first.cast("int").alias("start_column"), last.cast("int").alias("end_column"))


def _entity(identifier, kind, name, path, location, properties):
    return [identifier.alias("id"), kind.alias("type"), name.alias("name"), path.alias("path"), location.cast(S.LOCATION).alias("location"), properties.alias("properties"), F.lit(0).cast("long").alias("ord")]


def tree_tables(tree: DataFrame, name: str, abs_path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and CONTAINS of the repository, its directories and files (kind, path, content)."""
    repo, path = F.lit(f"repo:{name}"), F.col("path")
    parent = F.when(X.dir_name("path") == "", repo).otherwise(F.concat(F.lit("dir:"), X.dir_name("path")))
    root = tree.sparkSession.createDataFrame([(f"repo:{name}", "Repository", name, ".", None, json.dumps({"abs_path": abs_path, "language": "python"}, separators=(",", ":"), ensure_ascii=False), 0)], f"id string, type string, name string, path string, location {S.LOCATION}, properties string, ord long")
    folders, files = tree.where("kind = 'directory'"), tree.where("kind = 'file'")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    lines = F.coalesce(X.line_count(text), F.lit(0))
    properties = _json(module_name=X.module_name("path"), extension=F.lit(".py"), size_bytes=F.octet_length("content").cast("long"), line_count=lines)
    folder_id, file_id = F.concat(F.lit("dir:"), path), F.concat(F.lit("file:"), path)
    entities = root.union(folders.select(*_entity(folder_id, F.lit("Directory"), X.base_name("path"), path, F.lit(None), F.lit("{}")))).union(
        files.select(*_entity(file_id, F.lit("File"), X.base_name("path"), path, _place(path, F.lit(1), F.greatest(lines, F.lit(1)), F.lit(0), F.lit(0)), properties))
    )
    return entities, folders.select(*_contains(parent, folder_id)).union(files.select(*_contains(parent, file_id)))


def code_tables(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (with qualified_name and ord) and CONTAINS of classes, functions and methods."""
    path = F.col("path")
    kind = F.when(F.col("kind") == "class", "Class").when(F.col("is_method"), "Method").otherwise("Function")
    prefix = F.when(F.col("kind") == "class", "class:").when(F.col("is_method"), "method:").otherwise("func:")
    identifier = F.concat(prefix, path, F.lit(":"), F.col("qualified_name"))
    # Within a file classes come first, then functions, then methods.
    group = F.when(F.col("kind") == "class", 0).when(F.col("is_method"), 2).otherwise(1)
    common = {"qualified_name": F.col("qualified_name"), "docstring": F.col("docstring"), "decorators": F.col("decorators")}
    of_class = _json(**common, bases=F.transform("bases", lambda b: b["name"]))
    of_function = _json(**common, is_async=F.col("is_async"), parameters=F.col("parameters"), return_type=F.col("return_type"))
    defined = facts.where("kind IN ('class', 'function')")
    location = _place(path, F.col("start_line"), F.col("end_line"), F.col("start_column"), F.col("end_column"))
    properties = F.when(F.col("kind") == "class", of_class).otherwise(of_function)
    entities = defined.select(*_entity(identifier, kind, F.col("name"), path, location, properties)[:-1], "qualified_name", (group * F.lit(1 << 32) + F.col("ord")).alias("ord"))
    file_id = F.concat(F.lit("file:"), path)
    holder = F.when((F.col("kind") == "class") | F.col("parent").isNull(), file_id).when(F.col("is_method"), F.concat(F.lit("class:"), path, F.lit(":"), "parent")).otherwise(F.concat(F.lit("func:"), path, F.lit(":"), "parent"))
    return entities, defined.select(*_contains(holder, identifier))


def references(facts: DataFrame, entities: DataFrame, files: DataFrame) -> DataFrame:
    """IMPORTS, INHERITS and CALLS, with targets resolved where the tree has them."""
    symbols = symbol_table(entities.select("path", "name", "qualified_name", "id", "ord"))
    modules = files.select(X.module_name("path").alias("module"), "path").groupBy("module").agg(F.max("path").alias("path"))
    imports = facts.where("kind = 'import'").select("path", "ord", "module", "symbol", "alias", "is_wildcard", "start_line", "start_column")
    path = F.col("path")
    at = lambda line, col: _place(path, line, line, col, col)
    number = lambda c: F.col(c).cast("string")
    known = imports.join(modules.withColumnRenamed("path", "file"), "module", "left")
    source, target = F.concat(F.lit("file:"), path), F.when(F.col("file").isNotNull(), F.concat(F.lit("file:"), "file")).otherwise(F.concat(F.lit("module:"), "module"))
    out = known.select(*_relation("IMPORTS", source, target, F.concat(F.lit("rel:imports:"), source, F.lit("->"), target, F.lit(":"), number("start_line")), at(F.col("start_line"), F.col("start_column")), _json(imported_symbol=F.col("symbol"), alias=F.col("alias"), is_wildcard=F.col("is_wildcard")), F.col("ord")))

    bases = facts.where("kind = 'class'").select("path", "ord", F.concat(F.lit("class:"), path, F.lit(":"), "qualified_name").alias("owner"), F.posexplode("bases").alias("n", "b"))
    bases = bases.select("path", "ord", "owner", F.concat_ws(":", F.lit("b"), "path", "ord", "n").alias("ref"), F.col("b.name").alias("expr"), F.col("b.line").alias("start_line"), F.col("b.col").alias("start_column"))
    calls = facts.where("kind = 'call'").select("path", "ord", "owner", F.concat_ws(":", F.lit("c"), "path", "ord").alias("ref"), F.col("name").alias("expr"), "start_line", "start_column")
    both = bases.union(calls.select(*bases.columns))
    found = both.join(resolve(both.select("ref", "path", "expr"), imports, symbols, modules), "ref", "left")
    there = F.col("id").isNotNull()
    location = at(F.col("start_line"), F.col("start_column"))
    owner = F.col("owner")
    base = F.coalesce("id", F.concat(F.lit("external:"), "expr"))
    inherits = found.where("ref LIKE 'b:%'").select(*_relation("INHERITS", owner, base, F.concat(F.lit("rel:inherits:"), owner, F.lit("->"), base, F.lit(":"), number("start_line")), location, _json(raw_base_name=F.col("expr"), resolved=there), F.col("ord")))
    callee = F.coalesce("id", F.concat(F.lit("unresolved:"), "expr"))
    how = F.when(there, "symbol_table_match").otherwise("syntactic_only")
    identifier = F.concat(F.lit("rel:calls:"), owner, F.lit("->"), callee, F.lit(":"), number("start_line"), F.lit(":"), number("start_column"))
    return out.union(inherits).union(found.where("ref LIKE 'c:%'").select(*_relation("CALLS", owner, callee, identifier, location, _json(raw_call=F.col("expr"), resolved=there, confidence=how), F.col("ord"))))


@dataclass(frozen=True)
class Analysis:
    entities: DataFrame  # ord, as in relationships: the order of those with equal identifiers
    relationships: DataFrame
    metadata: dict[str, Any]
    contents: DataFrame  # path, content

    def stats(self) -> dict[str, int]:
        rels = flagged(self.relationships)
        unresolved = F.get_json_object("properties", "$.resolved") == "false"
        derived = F.get_json_object("properties", "$.derived") == "true"
        r = rels.agg(F.count("*").alias("n"), F.count_if(F.coalesce(derived, F.lit(False))).alias("derived"), F.count_if(F.coalesce(unresolved, F.lit(False))).alias("unresolved")).first()
        return {"total_entities": self.entities.count(), "total_relationships": r.n, "primitive_relationships": r.n - r.derived, "derived_relationships": r.derived, "unresolved_calls_count": r.unresolved}

    def _rows(self, table: DataFrame) -> list[dict]:
        """The table sorted by id, as the document holds it; a document is as large as its reader's memory anyway."""
        rows = [r.asDict(recursive=True) for r in table.orderBy("id", "ord").drop("ord").toLocalIterator()]
        return [r | {"properties": json.loads(r["properties"])} for r in rows]

    def to_dict(self) -> dict[str, Any]:
        return {"version": VERSION, "metadata": {**self.metadata, "stats": self.stats()}, "entities": self._rows(self.entities), "relationships": self._rows(self.relationships)}

    def canonical_dict(self, portable: bool = False) -> dict[str, Any]:
        """Without time and root; portable: without the repository's absolute path too."""
        entities = self._rows(self.entities)
        if portable:
            for e in entities:
                e["properties"].pop("abs_path", None)
        meta = {k: v for k, v in self.metadata.items() if k not in ("extracted_at", "root_path")}
        return {"version": VERSION, "metadata": meta, "entities": entities, "relationships": self._rows(self.relationships)}

    def canonical_hash(self, portable: bool = False) -> str:
        return hashlib.sha256(json.dumps(self.canonical_dict(portable), sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    def to_json(self, canonical_only: bool = False) -> str:
        return json.dumps(self.canonical_dict() if canonical_only else self.to_dict(), indent=2, ensure_ascii=False)

    def export(self, path: str | Path, canonical_only: bool = False) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(self.to_json(canonical_only) + "\n", encoding="utf-8")


def analyze_repository(spark: SparkSession, root: str, include_derived: bool = True, ignored: tuple[str, ...] | None = None) -> Analysis:
    """The entities and relationships of a source tree, with derived file dependencies unless left out."""
    name = os.path.basename(os.path.abspath(root))
    tree = read_tree(spark, root, ignored).persist()
    files = tree.where("kind = 'file'")
    facts = parse_files(files).persist()
    entities, contains = tree_tables(tree, name, os.path.abspath(root))
    code, code_contains = code_tables(facts)
    relationships = contains.union(code_contains).union(references(facts, code, files))
    if include_derived:
        derived = derive_depends_on_relationships(relationships.withColumn("is_derived", F.lit(False)))
        relationships = relationships.unionByName(derived.withColumn("ord", F.lit(0).cast("long")))
    metadata = {"repository_identity": f"repo:{name}", "root_path": os.path.abspath(root), "extracted_at": datetime.now(UTC).isoformat(), "analyzer_version": VERSION}
    return Analysis(entities.unionByName(code.drop("qualified_name")), relationships, metadata, files.select("path", "content"))
