"""Cutting the lineage of iterative plans in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifiers that go into a filter, and rows that go to all tasks; beyond, rows are shuffled.
LISTED, SENT = 1000, 1 << 20
#: Rows that are shuffled at once where passes over parts of the keys do.
AT_ONCE = 1 << 25


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint directory (spark.checkpoint.dir); a local session without one gets one."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkweft-"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; a lost executor doesn't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """As cut, for large tables: compressed columns, and the shuffles that made them go at once.

    Rows come in another order and other partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    freed(spark)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Lets go of the shuffles of plans that are used no more."""
    gc.collect()  # of plans on the Python side, then of what they hold in the driver
    spark._jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Removes what kept wrote of df, which is not read again."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, column: str, most: int) -> list | None:
    """The column's values if there are no more rows than that."""
    rows = df.select(column).limit(most + 1).collect()
    return [r[0] for r in rows] if len(rows) <= most else None


def to_all(df: DataFrame, rows: int) -> DataFrame:
    """df of so many rows for a join: sent to all tasks while it is small, so that the other side stays where it is."""
    return F.broadcast(df) if rows <= SENT else df
