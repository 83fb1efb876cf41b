"""Places of rows in an order across all rows, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import kept


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """rows with their place from 0 in the order, which must tell all rows apart.

    Ranges are numbered by themselves, from where the ranges before them end; one row a range comes to the driver.
    """
    part, begin = f"_{name}_part", f"_{name}_begin"
    dealt = kept(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    begins, total = [], 0
    for r in sorted(dealt.groupBy(part).count().collect()):
        begins.append((r[part], total))
        total += r["count"]
    starts = rows.sparkSession.createDataFrame(begins, f"{part} int, {begin} long")
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return dealt.join(F.broadcast(starts), part).withColumn(name, within + F.col(begin)).drop(part, begin)
