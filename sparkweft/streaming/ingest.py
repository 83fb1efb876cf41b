"""Streams of nodes and edges into a stored graph, as deltas, and windowed counts of events."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import schema as S
from ..operators.build import merged_rows
from ..operators.graph import PropertyGraph

_KEYS = {"nodes": ["id"], "edges": ["source", "target", "key"]}
_ORDER = {"nodes": "node_ord", "edges": "edge_ord"}
_SCHEMA = {"nodes": S.NODES, "edges": S.EDGES}
_ERROR = {"nodes": S.NodeAlreadyExistsError, "edges": S.RelationshipAlreadyExistsError}


def _stored(spark: SparkSession, store: str, kind: str, but: str | None = None) -> DataFrame:
    """The rows of all deltas (column delta), without one of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{kind}")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    schema = f"{_SCHEMA[kind]}, delta string"
    rows = spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(f"{store}/{kind}") if there else spark.createDataFrame([], schema)
    return rows if but is None else rows.where(F.col("delta") != but)


def stored_graph(spark: SparkSession, store: str) -> PropertyGraph:
    """The graph in the store: of rows with one key what any of them has, which don't contradict one another."""
    return PropertyGraph(*(merged_rows(_stored(spark, store, kind).drop("delta"), _KEYS[kind], _ORDER[kind]) for kind in _KEYS))


def _ingest(spark: SparkSession, kind: str, source: str, store: str, checkpoint: str) -> StreamingQuery:
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    keys, values = _KEYS[kind], [c.split()[0] for c in _SCHEMA[kind].replace(S.LOCATION, "location").split(", ")]
    values = [c for c in values if c not in (*_KEYS[kind], _ORDER[kind])]

    def add(batch: DataFrame, number: int) -> None:
        # A delta is named by its stream and number: one that comes again replaces itself, and streams don't meet.
        delta = f"{stream}-{number}"
        batch = batch.persist()
        old = _stored(spark, store, kind, delta).join(batch.select(*keys).distinct(), keys, "left_semi").drop("delta")
        both = old.unionByName(batch).groupBy(*keys).agg(*(F.min(F.col(c).cast("string")).alias(f"a_{c}") for c in values), *(F.max(F.col(c).cast("string")).alias(f"b_{c}") for c in values))
        clash = F.greatest(*(F.coalesce(F.col(f"a_{c}") != F.col(f"b_{c}"), F.lit(False)) for c in values))
        wrong = both.where(clash).select(*keys).head()
        if wrong:
            raise _ERROR[kind](f"{' -> '.join(wrong)} already exists with other values.")
        if kind == "edges":
            ids = _stored(spark, store, "nodes").select("id").distinct()
            for end in ("source", "target"):
                lost = batch.join(ids.withColumnRenamed("id", end), end, "left_anti").select(end).head()
                if lost:
                    raise S.NodeNotFoundError(f"{end.capitalize()} node '{lost[0]}' does not exist in graph.")
        batch.write.mode("overwrite").parquet(f"{store}/{kind}/delta={delta}")
        batch.unpersist()

    rows = spark.readStream.schema(_SCHEMA[kind]).parquet(source)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_nodes(spark: SparkSession, source: str, store: str, checkpoint: str) -> StreamingQuery:
    """Adds Parquet files of nodes that arrive in source to the graph in store; what is there already may come again.

    Each batch is written by itself and compared only with stored rows of its own keys. A batch that is
    repeated after a failure replaces what it wrote.
    """
    return _ingest(spark, "nodes", source, store, checkpoint)


def ingest_edges(spark: SparkSession, source: str, store: str, checkpoint: str) -> StreamingQuery:
    """The same for edges, whose ends must be in the store."""
    return _ingest(spark, "edges", source, store, checkpoint)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events (ts, event_type, value) counted and summed in tumbling windows; works on streams and tables alike.

    A watermark needs a time with a zone, so a stream's times without one are taken in the session's.
    """
    if events.isStreaming and dict(events.dtypes)["ts"] == "timestamp_ntz":
        return windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), late, width).withColumn("start", F.col("start").cast("timestamp_ntz"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
