"""File dependencies derived from relationships between their entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import file_of_id


def file_dependencies(relationships: DataFrame) -> DataFrame:
    """(source_file, target_file, reasons, weight): files whose entities relate, with the sorted types that do."""
    pairs = relationships.where("NOT coalesce(is_derived, false)").select(file_of_id("source").alias("source_file"), file_of_id("target").alias("target_file"), "type")
    # Dealt out as they are: sets gathered before the shuffle are larger than the types they hold.
    crossing = pairs.where("source_file <> target_file").repartition("source_file", "target_file")
    return crossing.groupBy("source_file", "target_file").agg(F.sort_array(F.collect_set("type")).alias("reasons")).withColumn("weight", F.size("reasons").cast("long"))


def derive_depends_on_relationships(relationships: DataFrame) -> DataFrame:
    """file_dependencies as relationships: id, source, target, type, location, properties."""
    found = file_dependencies(relationships)
    source, target = F.concat(F.lit("file:"), "source_file"), F.concat(F.lit("file:"), "target_file")
    properties = F.to_json(F.struct(F.lit(True).alias("derived"), "reasons", "weight"))
    return found.select(F.concat(F.lit("rel:depends_on:"), source, F.lit("->"), target).alias("id"), source.alias("source"), target.alias("target"), F.lit("DEPENDS_ON").alias("type"), F.lit(None).cast("struct<file:string,start_line:int,end_line:int,start_column:int,end_column:int>").alias("location"), properties.alias("properties"))
