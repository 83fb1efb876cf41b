"""Names in source code resolved to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def symbol_table(entities: DataFrame) -> DataFrame:
    """(path, symbol, id) of entities (path, name, qualified_name, id, ord): of several with a symbol, the last.

    An entity has its qualified name and, later in the order, its bare one.
    """
    both = F.array(F.struct(F.col("qualified_name").alias("symbol"), (2 * F.col("ord")).alias("place")), F.struct(F.col("name").alias("symbol"), (2 * F.col("ord") + 1).alias("place")))
    return entities.select("path", "id", F.explode(both).alias("s")).groupBy("path", F.col("s.symbol").alias("symbol")).agg(F.max_by("id", "s.place").alias("id"))


def prefixes(expr: Column) -> Column:
    """All dotted beginnings of an expression, the whole one too."""
    parts = F.split(expr, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def matching_imports(references: DataFrame, imports: DataFrame) -> DataFrame:
    """References (ref, path, expr) with the imports (path, match, ...) of their file whose name is the expression or a dotted beginning of it.

    The condition "equal, or begins with the name and a dot" as an equality on beginnings.
    """
    dotted = references.select("ref", "path", "expr", F.explode(prefixes(F.col("expr"))).alias("match"))
    return dotted.join(imports, ["path", "match"])


def resolve(references: DataFrame, imports: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """(ref, id) of references (ref, path, expr): a symbol of the same file, else of the first import that has it.

    imports: path, ord, module, symbol, alias. An import is known by its alias, symbol or the module's
    last part, and stands for its symbol or else the expression's last part, in the module's file.
    """
    own = references.join(symbols.withColumnRenamed("symbol", "expr"), ["path", "expr"]).select("ref", F.lit(-1).cast("long").alias("ord"), "id")
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    named = imports.select("path", "ord", F.coalesce("alias", "symbol", last(F.col("module"))).alias("match"), F.col("module"), F.col("symbol").alias("imported"))
    placed = matching_imports(references, named).join(modules.select("module", F.col("path").alias("target_path")), "module")
    wanted = F.coalesce("imported", last(F.col("expr")))
    other = placed.withColumn("symbol", wanted).join(symbols.withColumnRenamed("path", "target_path"), ["target_path", "symbol"]).select("ref", "ord", "id")
    return own.union(other).groupBy("ref").agg(F.min_by("id", "ord").alias("id"))
