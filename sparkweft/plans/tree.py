"""A source tree made from the tables, and what an analysis of it must find, in SQL.

A nation is a package in its region's directory, with a base module; each of its suppliers is a module
with a class, a method, and a function that calls both classes.
"""

from __future__ import annotations

import os
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_dir
from ..sources.analyzer import Analysis, analyze_repository
from . import star

BASE = "class Nation:\n    key = int({n})\n"
SUPPLIER = """from r{r}.n{n}.base import Nation


class Supplier{s}(Nation):
    def parts(self, count):
        return self.listed(count)


def make{s}():
    return Supplier{s}(Nation())
"""


def written(spark: SparkSession, sf_dir: str) -> str:
    """The tree's root, in the folder that driver and executors share, which must be a path of theirs; the executors write it."""
    place = urlparse(shared_dir(spark))
    if place.scheme not in ("", "file"):
        raise ValueError("a source tree needs a shared folder that is mounted")
    root = f"{place.path}/tree-{star.fingerprint(spark, sf_dir, 'nation', 'supplier')}/star"
    nation, supplier = star.tables(spark, sf_dir, "nation", "supplier")
    n = nation.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"))
    files = n.withColumn("s", F.lit(None).cast("long")).unionByName(supplier.select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").cast("long").alias("s")).join(n, "n"))

    def write(batches):
        for batch in batches:
            for row in batch.to_pylist():
                folder = f"{root}/r{row['r']}/n{row['n']}"
                os.makedirs(folder, exist_ok=True)
                path = f"{folder}/base.py" if row["s"] is None else f"{folder}/s{row['s']}.py"
                spare = f"{path}.{os.getpid()}"
                with open(spare, "w", encoding="utf-8") as out:
                    out.write((BASE if row["s"] is None else SUPPLIER).format(**row))
                os.replace(spare, path)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    files.select("r", "n", "s").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return root


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return analyze_repository(spark, written(spark, sf_dir))


_CLASS = """'{"bases":[' || bases || '],"decorators":[],"docstring":null,"qualified_name":"' || name || '"}'"""
_FUNCTION = """'{"decorators":[],"docstring":null,"is_async":false,"parameters":[' || args || '],"qualified_name":"' || qualified || '","return_type":null}'"""

#: Common tables: t (nations), m (suppliers), entities (id, type, name, path, properties of code), rels (id, source, target, type).
SQL = f"""
t AS (SELECT 'r' || n_regionkey AS region, 'r' || n_regionkey || '/n' || n_nationkey AS dir, n_nationkey AS n FROM nation),
m AS (SELECT dir, dir || '/s' || s_suppkey || '.py' AS path, s_suppkey AS s FROM supplier JOIN t ON s_nationkey = n),
entities AS (
  SELECT 'repo:star' AS id, 'Repository' AS type, 'star' AS name, '.' AS path, NULL AS properties
  UNION ALL SELECT DISTINCT 'dir:' || region, 'Directory', region, region, NULL FROM t UNION ALL SELECT 'dir:' || dir, 'Directory', 'n' || n, dir, NULL FROM t
  UNION ALL SELECT 'file:' || dir || '/base.py', 'File', 'base.py', dir || '/base.py', NULL FROM t UNION ALL SELECT 'file:' || path, 'File', 's' || s || '.py', path, NULL FROM m
  UNION ALL SELECT 'class:' || dir || '/base.py:Nation', 'Class', name, dir || '/base.py', {_CLASS} FROM (SELECT dir, 'Nation' AS name, '' AS bases FROM t)
  UNION ALL SELECT 'class:' || path || ':' || name, 'Class', name, path, {_CLASS} FROM (SELECT path, 'Supplier' || s AS name, '"Nation"' AS bases FROM m)
  UNION ALL SELECT 'method:' || path || ':' || qualified, 'Method', 'parts', path, {_FUNCTION} FROM (SELECT path, 'Supplier' || s || '.parts' AS qualified, '"self","count"' AS args FROM m)
  UNION ALL SELECT 'func:' || path || ':' || qualified, 'Function', qualified, path, {_FUNCTION} FROM (SELECT path, 'make' || s AS qualified, '' AS args FROM m)),
ends AS (
  SELECT 'contains' AS k, 'repo:star' AS source, id AS target, '' AS line FROM entities WHERE type = 'Directory' AND path NOT LIKE '%/%'
  UNION ALL SELECT 'contains', 'dir:' || region, 'dir:' || dir, '' FROM t
  UNION ALL SELECT 'contains', 'dir:' || dir, 'file:' || dir || '/base.py', '' FROM t UNION ALL SELECT 'contains', 'dir:' || dir, 'file:' || path, '' FROM m
  UNION ALL SELECT 'contains', 'file:' || path, id, '' FROM entities WHERE type IN ('Class', 'Function')
  UNION ALL SELECT 'contains', 'class:' || path || ':Supplier' || s, 'method:' || path || ':Supplier' || s || '.parts', '' FROM m
  UNION ALL SELECT 'imports', 'file:' || path, 'file:' || dir || '/base.py', ':1' FROM m
  UNION ALL SELECT 'inherits', 'class:' || path || ':Supplier' || s, 'class:' || dir || '/base.py:Nation', ':4' FROM m
  UNION ALL SELECT 'depends_on', 'file:' || path, 'file:' || dir || '/base.py', '' FROM m
  UNION ALL SELECT 'calls', 'file:' || dir || '/base.py', 'unresolved:int', ':2:10' FROM t
  UNION ALL SELECT 'calls', 'method:' || path || ':Supplier' || s || '.parts', 'unresolved:self.listed', ':6:15' FROM m
  UNION ALL SELECT 'calls', 'func:' || path || ':make' || s, 'class:' || path || ':Supplier' || s, ':10:11' FROM m
  UNION ALL SELECT 'calls', 'func:' || path || ':make' || s, 'class:' || dir || '/base.py:Nation', ':10:' || (20 + len(CAST(s AS VARCHAR))) FROM m),
rels AS (SELECT 'rel:' || k || ':' || source || '->' || target || line AS id, source, target, upper(k) AS type FROM ends)
"""
