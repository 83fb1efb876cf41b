"""Approximate nearest neighbours by inner product with an inverted multi-index.

Both halves of a vector are quantised apart, so K centroids a half make K x K cells, and K grows with
the square root of the rows. A query walks the cells by summed distance (here: falling summed inner
product) with a heap. It stops where the cells left are expected to hold less than MISSING of its k
nearest: for a cell, scores are taken as normal around the centroids' sum, with the spread measured
over all rows of the index. The score that about k rows exceed is estimated on COARSE x COARSE groups
of cells, so a query's work before the walk doesn't grow with K x K. Entries of the cells walked are
reranked by the exact inner product in double precision.

Cells lie in parts of bounded size, and a crowded cell in several. A part goes to as many tasks as
there are blocks of queries that want it, and to none that don't, so the rows shuffled grow with rows
and queries, and no task holds more than one part and one block of queries.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows that the centroids are fitted to, about (a random sample beyond), rows to a cell, and centroids of a half at
#: most: the counts of CENTROIDS x CENTROIDS cells, 8 MiB, go to every worker.
SAMPLE, PER_CELL, CENTROIDS = 16_384, 48, 1024
#: Groups of centroids of a half, on which the score of the k nearest is estimated.
COARSE = 64
#: The share of the k nearest that a walk may be expected to miss.
MISSING = 0.02
#: Vectors of a part and queries of a block, in a task; queries scored at a time; queries that a task routes.
PART, BLOCK, AT_ONCE, ROUTED = 16_384, 8_192, 256, 2_048


def _upper(x: np.ndarray) -> np.ndarray:
    """The normal distribution's upper tail (Abramowitz and Stegun 26.2.17)."""
    a = np.abs(x)
    t = 1 / (1 + 0.2316419 * a)
    tail = np.exp(-a * a / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, tail, 1 - tail)


def _fit(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's algorithm; an empty one stays where it is."""
    rng = np.random.default_rng(0)
    centres = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(sample, centres)
        for j in range(k):
            if (near == j).any():
                centres[j] = sample[near == j].mean(axis=0)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


@dataclass
class Coarse:
    """Groups of a half's centroids: their means, how far rows spread around them by component, and the group of each centroid."""

    centre: np.ndarray
    spread: np.ndarray
    of: np.ndarray

    @staticmethod
    def made(centres: np.ndarray, spread: np.ndarray, rows: np.ndarray) -> Coarse:
        k = min(COARSE, len(centres))
        of = np.arange(k) if k == len(centres) else _nearest(centres, _fit(centres, k))
        weight = np.maximum(np.bincount(of, rows, k), 1e-12)[:, None]
        mean = lambda x: np.stack([np.bincount(of, x[:, c] * rows, k) for c in range(x.shape[1])], axis=1) / weight if x.shape[1] else np.zeros((k, 0))
        centre = mean(centres)
        return Coarse(centre, mean(spread + (centres - centre[of]) ** 2), of)


@dataclass
class Cells:
    """The quantisers, what is known of each cell, and the parts that hold it."""

    first: np.ndarray
    second: np.ndarray
    count: np.ndarray | None = None  # of rows, K x K
    spread: tuple[np.ndarray, np.ndarray] | None = None  # variance by component around each centroid
    parts: tuple[np.ndarray, np.ndarray] | None = None  # a cell's first part, and in how many it lies
    coarse: tuple[Coarse, Coarse, np.ndarray] | None = None  # of both halves, and the rows of their pairs

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        return _nearest(rows[:, : self.half], self.first) * len(self.second) + _nearest(rows[:, self.half :], self.second)

    def _wanted(self, q1: np.ndarray, q2: np.ndarray, k: int) -> tuple[float, float]:
        """The score that about k rows exceed, and how many rows are expected to exceed it."""
        a, b, count = self.coarse
        mean = (a.centre @ q1)[:, None] + (b.centre @ q2)[None, :]
        sd = np.sqrt((a.spread @ (q1 * q1))[:, None] + (b.spread @ (q2 * q2))[None, :])
        sd = np.maximum(sd, 1e-9 * (1 + np.abs(mean).max()))
        low, high = float((mean - 8 * sd).min()), float((mean + 8 * sd).max())
        for _ in range(14):
            middle = (low + high) / 2
            low, high = (middle, high) if (count * _upper((middle - mean) / sd)).sum() > k else (low, middle)
        return low, float((count * _upper((low - mean) / sd)).sum())

    def walk(self, query: np.ndarray, k: int) -> list[int]:
        """Cells in the order of their summed distance, as far as the k nearest need."""
        q1, q2 = query[: self.half], query[self.half :]
        least, missing = self._wanted(q1, q2, k)
        left = missing * MISSING
        d1, d2 = -(self.first @ q1), -(self.second @ q2)
        v1, v2 = self.spread[0] @ (q1 * q1), self.spread[1] @ (q2 * q2)
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        s1, s2, v1, v2, n2 = d1[o1].tolist(), d2[o2].tolist(), v1[o1].tolist(), v2[o2].tolist(), len(o2)
        o1, o2, count = o1.tolist(), o2.tolist(), self.count
        far = 6 * math.sqrt(max(v1) + max(v2))  # beyond it a cell holds nothing that exceeds `least`
        heap, found, rows, done = [(s1[0] + s2[0], 0, 0)], [], 0, [0] * len(s1)
        while heap:
            distance, i, j = heapq.heappop(heap)
            if rows >= 4 * k and (missing <= left or distance > far - least):
                break
            n = int(count[o1[i], o2[j]])
            if n:
                found.append(o1[i] * n2 + o2[j])
                rows += n
                missing -= n * math.erfc((least + distance) / max(1e-9 * (1 + abs(distance)), math.sqrt(2 * (v1[i] + v2[j])))) / 2
            done[i] = j + 1
            # (i, j + 1) waits until (i - 1, j + 1) has been walked, and (i + 1, j) until (i + 1, j - 1) has.
            if j + 1 < n2 and (i == 0 or done[i - 1] > j + 1):
                heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
            if i + 1 < len(s1) and done[i + 1] == j:
                heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
        return found


def _good(table: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return table.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def _vectors(table: DataFrame) -> tuple[DataFrame, int, int]:
    """vec_id and v (array<double>) of the rows that take part, how many, and their components (0: none takes part).

    Rows without id, with null, zero or non-finite vectors, or with another number of components than
    most rows have (of equals, the smaller number) take no part.
    """
    good = _good(table)
    most = good.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return (good.where(F.size("v") == most["size"]), most["count"], most["size"]) if most else (good, 0, 0)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def build(good: DataFrame, n: int, size: int) -> Cells:
    """Quantisers from the sample; counts, spreads and parts of the cells from every row."""
    some = good.where(F.rand(0) < SAMPLE / n) if n > SAMPLE else good
    sample = np.array([r.v for r in some.collect()])
    k = int(min(max(1, (n / PER_CELL) ** 0.5), CENTROIDS, len(sample)))
    half = (size + 1) // 2
    cells = Cells(_fit(sample[:, :half], k), _fit(sample[:, half:], k) if size > 1 else np.zeros((1, 0)))
    wide = len(cells.second)

    def measure(batches):
        count = np.zeros(k * wide, np.int64)
        squares = [np.zeros((k, half)), np.zeros((wide, size - half))]
        for batch in batches:
            rows = _matrix(batch.column(1), size)
            at = cells.assign(rows)
            count += np.bincount(at, minlength=len(count))
            np.add.at(squares[0], at // wide, (rows[:, :half] - cells.first[at // wide]) ** 2)
            np.add.at(squares[1], at % wide, (rows[:, half:] - cells.second[at % wide]) ** 2)
        yield pa.RecordBatch.from_pydict({"count": [count.tolist()], "a": [squares[0].ravel().tolist()], "b": [squares[1].ravel().tolist()]})

    # Element by element, so that tasks add up before one row a cell or component comes to the driver.
    told = good.mapInArrow(measure, "count array<long>, a array<double>, b array<double>")
    sums = told.select(F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(c).cast("array<double>").alias("x")) for i, c in enumerate(("count", "a", "b"))))).alias("s")).select("s.kind", F.posexplode("s.x").alias("at", "x")).where("x <> 0").groupBy("kind", "at").agg(F.sum("x").alias("x"))
    total = [np.zeros(k * wide), np.zeros(k * half), np.zeros(wide * (size - half))]
    for r in sums.collect():
        total[r.kind][r.at] = r.x
    cells.count = total[0].reshape(k, wide)
    cells.spread = (total[1].reshape(k, half) / np.maximum(cells.count.sum(axis=1), 1)[:, None], total[2].reshape(wide, size - half) / np.maximum(cells.count.sum(axis=0), 1)[:, None])
    a, b = Coarse.made(cells.first, cells.spread[0], cells.count.sum(axis=1)), Coarse.made(cells.second, cells.spread[1], cells.count.sum(axis=0))
    coarse = np.zeros((len(a.centre), len(b.centre)))
    np.add.at(coarse, (a.of[:, None], b.of[None, :]), cells.count)
    cells.coarse = a, b, coarse
    first, pieces, part, room = np.zeros(k * wide, np.int64), np.ones(k * wide, np.int64), 0, PART
    for cell, rows in enumerate(cells.count.ravel().astype(np.int64).tolist()):
        if rows > room:
            part, room = part + 1, PART
        first[cell] = part
        if rows > PART:
            pieces[cell] = -(-rows // PART)
            part, room = part + int(pieces[cell]), PART
        else:
            room -= rows
    cells.parts, cells.count = (first, pieces), cells.count.astype(np.int64)
    return cells


def search(table: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest rows found, ties to the smaller vec_id.

    Both have vec_id and embedding. Rows with a query's own vec_id are no candidates for it; of others
    with one vec_id each row is one. A vec_id on several rows is one query, by its smallest vector. Rows
    that take no part (see _vectors) are neither; other columns are ignored; an empty table gives no rows.
    """
    good, n, size = _vectors(table)
    kind = table.schema["vec_id"].dataType.simpleString()
    if not n:
        return good.selectExpr("vec_id AS query_id", "cast(0 AS int) AS rank", "vec_id", "cast(0 AS double) AS score").limit(0)
    cells = build(good, n, size)
    asked = _good(queries).where(F.size("v") == size).groupBy("vec_id").agg(F.min("v").alias("v"))

    def place(batches):
        first, pieces = cells.parts
        for batch in batches:
            rows = _matrix(batch.column(1), size)
            cell = cells.assign(rows)
            salt = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in rows], pa.binary()), pa.array(cell, pa.int64()), pa.array(first[cell] + salt % pieces[cell], pa.int64())], ["vec_id", "v", "cell", "part"])

    def route(batches):
        first, pieces = cells.parts
        for batch in batches:
            out = []
            for key, vector in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), size), strict=True):
                by: dict[int, list[int]] = {}
                for cell in cells.walk(vector, k):
                    for part in range(first[cell], first[cell] + pieces[cell]):
                        by.setdefault(part, []).append(cell)
                out += [(key, vector.tobytes(), part, found) for part, found in by.items()]
            columns = zip(*out, strict=True) if out else [[]] * 4
            types = [batch.schema.field(0).type, pa.binary(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["vec_id", "v", "part", "cells"])

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and held.num_rows:
            ids, cell = held["vec_id"].to_numpy(), held["cell"].to_numpy()
            rows = np.frombuffer(b"".join(held["v"].to_pylist()), float).reshape(-1, size)
            order = np.lexsort((ids, cell))
            ids, cell, rows = ids[order], cell[order], rows[order]
            kinds, begin = np.unique(cell, return_index=True)
            bounds = dict(zip(kinds.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(cell)], strict=True), strict=True))
            keys = asked["vec_id"].to_pylist()
            vectors = np.frombuffer(b"".join(asked["v"].to_pylist()), float).reshape(-1, size)
            wanted = asked["cells"].to_pylist()
            for at in range(0, len(keys), AT_ONCE):
                some = vectors[at : at + AT_ONCE]
                scores = np.full((len(some), len(ids)), -np.inf)
                by: dict[int, list[int]] = {}
                for i, cs in enumerate(wanted[at : at + AT_ONCE]):
                    for c in cs:
                        if c in bounds:
                            by.setdefault(c, []).append(i)
                for c, which in by.items():
                    a, b = bounds[c]
                    scores[which, a:b] = some[which] @ rows[a:b].T
                for i, key in enumerate(keys[at : at + AT_ONCE]):
                    line = scores[i]
                    line[ids == key] = -np.inf
                    cut = np.partition(line, -k)[-k] if len(line) > k else -np.inf
                    near = np.flatnonzero((line >= cut - 1e-9 * max(1.0, abs(cut))) & (line > -np.inf)) if cut > -np.inf else np.flatnonzero(line > -np.inf)
                    exact = (rows[near] * some[i]).sum(axis=1)  # the same for equal vectors, wherever they lie
                    best = np.lexsort((ids[near], -exact))[:k]
                    out += [(key, v, s) for v, s in zip(ids[near][best].tolist(), exact[best].tolist(), strict=True)]
        types = [asked.schema.field("vec_id").type, held.schema.field("vec_id").type, pa.float64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, types, strict=True)], ["query_id", "vec_id", "score"])

    salted = good.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)).alias("salt"))
    index = salted.mapInArrow(place, f"vec_id {kind}, v binary, cell long, part long")
    tasks = max(table.sparkSession.sparkContext.defaultParallelism, -(-queries.count() // ROUTED))
    routed = common.cut(asked.repartition(tasks, "vec_id").mapInArrow(route, f"vec_id {kind}, v binary, part long, cells array<long>"))
    blocks = routed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
    dealt = routed.join(blocks, "part").withColumn("block", block).drop("blocks")
    copies = index.join(blocks, "part").select("vec_id", "v", "cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    found = dealt.groupBy("part", "block").cogroup(copies.groupBy("part", "block")).applyInArrow(lambda a, b: rerank(a.drop_columns(["part", "block"]), b.drop_columns(["part", "block"])), f"query_id {kind}, vec_id {kind}, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark, sf_dir):
    table = common.table(spark, sf_dir, "embeddings")
    return search(table, table.where(F.col("vec_id") % 20 == 0))
