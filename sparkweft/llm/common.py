"""What the operators share: tables, Arrow batches of bounded size, the shared folder, lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker holds at once, besides one text of any length.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint directory.

    It comes from spark.checkpoint.dir. Only a session without one, as in tests, gets a folder of its own.
    """
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkweft-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def free(name: str, columns: list[str]) -> str:
    """The name, or one like it that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; a lost executor doesn't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_columns(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text as string (null: empty) and the columns named, whatever else docs has."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts take at most BATCH_BYTES, or one row."""
    if batch.num_rows == 0:
        return
    at = batch.schema.get_field_index(column)
    sizes = pc.binary_length(batch.column(at)).to_pylist()
    begin = total = 0
    for i, size in enumerate(sizes):
        size = size or 0
        if i > begin and total + size > BATCH_BYTES:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    yield batch.slice(begin)


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """work applied to slices of df on the executors; its batches have the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def append(docs: DataFrame, name: str, kind: pa.DataType, sql: str, work: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """docs with a column `name` (a column of that name gives way): work applied to texts, null ones as empty."""
    columns = [c for c in docs.columns if c != name]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, given):
                made = work(part.column(len(columns)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], made.cast(kind)], [*columns, name])

    given = free("_text", columns)
    texts = docs.select(*(f"`{c}`" for c in columns), F.coalesce(F.col("text").cast("string"), F.lit("")).alias(given))
    return texts.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in columns) + f", `{name}` {sql}")
