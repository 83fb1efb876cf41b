"""Entities as text chunks for retrieval, and the vectors of chunks."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Sequence
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from .build import _loaded, tables
from .graph import PropertyGraph

CHUNK_TYPES = ("file", "class", "function", "method")


def _chunks(entities: DataFrame, sources: DataFrame | None, repository: str) -> DataFrame:
    """Chunks of entities (id, type, name, path, location, properties); sources: path, content."""
    kept = entities.withColumn("entity_type", F.lower("type")).where(F.col("entity_type").isin(*CHUNK_TYPES))
    # Properties may be of any kind, so each is read by itself and what has another kind is missing.
    strings = lambda key: F.try_variant_get(F.try_parse_json("properties"), f"$.{key}", "array<string>")
    text = lambda key: F.get_json_object("properties", f"$.{key}")
    if sources is None:
        kept = kept.withColumn("_content", F.lit(None).cast("string"))
    else:
        content = F.col("content").cast("string")
        readable = sources.select("path", F.when(F.is_valid_utf8(content), content).alias("_content"))
        kept = kept.join(readable, "path", "left")
    qualified = X.qualified_name(F.coalesce(text("qualified_name"), F.lit("")), "id", "name")
    arguments = F.coalesce(strings("args"), strings("parameters"))
    sign = X.signature(F.coalesce(text("signature"), F.lit("")), F.col("entity_type"), F.col("name"), arguments, strings("bases"))
    sliced = X.line_slice("_content", F.col("location.start_line"), F.col("location.end_line"))
    source = F.coalesce(X.blank_to_null(sliced), text("source_code"), F.lit(""))
    out = kept.withColumns({"qualified_name": qualified, "signature": sign, "docstring": text("docstring"), "source_code": source})
    return out.select(
        F.lit(repository).alias("repository_id"), F.col("id").alias("entity_id"), "entity_type", "name", "qualified_name", F.col("path").alias("file_path"),
        F.col("location.start_line").alias("start_line"), F.col("location.end_line").alias("end_line"), "signature", "docstring", "source_code",
        X.chunk_text(F.col("entity_type"), F.col("name"), F.col("qualified_name"), F.col("path"), F.col("signature"), F.col("docstring"), F.col("source_code")).alias("text_representation"),
        F.col("properties").alias("metadata"),
    )


def chunk_entities(entities: DataFrame, sources: DataFrame | None = None, repository: str = "repository") -> DataFrame:
    return _chunks(entities, sources, repository)


def chunk_analysis(spark: SparkSession, data: dict | str | Path, sources: DataFrame | None = None) -> DataFrame:
    """Chunks of an analysis document's files, classes, functions and methods."""
    loaded = _loaded(data)
    return _chunks(tables(spark, loaded)[0], sources, (loaded.get("repository") or {}).get("name") or "repository")


def chunk_analysis_file(spark: SparkSession, path: str | Path, sources: DataFrame | None = None) -> DataFrame:
    if not Path(path).is_file():
        raise FileNotFoundError(f"Analysis file not found: {path}")
    return chunk_analysis(spark, Path(path), sources)


def chunk_graph(graph: PropertyGraph, sources: DataFrame | None = None) -> DataFrame:
    """Chunks of a graph's nodes, placeholders left out; a chunk needs a path."""
    nodes = graph.nodes.where(~F.coalesce("is_synthetic", F.lit(False)))
    if not nodes.where(F.lower("type").isin(*CHUNK_TYPES) & F.col("path").isNull()).isEmpty():
        raise ValueError("a node to chunk has no path")
    return _chunks(nodes, sources, graph.metadata.get("name") or "repository")


class Embedder(Protocol):
    """Texts to vectors of `dimension` floats with length one (or zero); workers call it on whole batches."""

    dimension: int

    def __call__(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Feature hashing of words and their pairs: the default where no model is at hand."""

    def __init__(self, dimension: int = 768):
        self.dimension = dimension

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._vector(t or "") for t in texts]

    def _vector(self, text: str) -> list[float]:
        words = re.findall(r"[A-Za-z]+|[0-9]+", text.lower())
        out = [0.0] * self.dimension
        for feature in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
            h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
            out[h % self.dimension] += 1.0 if h >> 63 else -1.0
        size = math.sqrt(sum(x * x for x in out))
        return [x / size for x in out] if size else out


_models: dict[object, object] = {}


class PooledEmbedder:
    """Any model of token vectors, as an Embedder: the mean over a text's tokens by the mask, with length one.

    load() gives the model, which each worker loads once, when it is first needed. The model takes texts
    and the most tokens of one, and gives their token vectors and masks (0 for padding), texts padded to one length.
    """

    def __init__(self, load, dimension: int, longest: int = 512, batch: int = 16):
        self.load, self.dimension, self.longest, self.batch = load, dimension, longest, batch

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        import numpy as np

        if self.load not in _models:
            _models[self.load] = self.load()
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            some = [t or "" for t in texts[at : at + self.batch]]
            vectors, mask = _models[self.load](some, self.longest)
            mask = np.asarray(mask, float).reshape(len(some), -1, 1)
            vectors = np.asarray(vectors, float).reshape(len(some), -1, self.dimension)
            mean = (vectors * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1e-9)
            size = np.linalg.norm(mean, axis=1, keepdims=True)
            out += (mean / np.where(size > 0, size, 1)).tolist()
        return out


def embed_text(text: str, embedder: Embedder | None = None) -> list[float]:
    """The vector of one text."""
    return (embedder or HashingEmbedder())([text])[0]


def embed(chunks: DataFrame, embedder: Embedder | None = None, text: str = "text_representation") -> DataFrame:
    """chunks with an embedding (array<float>) of the text column; null texts count as empty."""
    use = embedder or HashingEmbedder()
    columns = [c for c in chunks.columns if c != "embedding"]
    at = columns.index(text)

    def run(batches):
        for batch in batches:
            vectors = pa.array(use(batch.column(at).to_pylist()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], [*columns, "embedding"])

    types = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    return chunks.select(*columns).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in columns) + ", embedding array<float>")


def save_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def chunk_dict(row) -> dict:
    """A chunk as a dict, its metadata decoded."""
    found = row.asDict(recursive=True)
    return found | {"metadata": json.loads(found["metadata"] or "{}")}
