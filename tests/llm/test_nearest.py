import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkweft.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for q in queries:
        s = (x * x[np.flatnonzero(ids == q)[0]]).sum(axis=1)
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in best]
    return out


@pytest.mark.parametrize(("shape", "coarse"), [("uniform", 64), ("clusters", 64), ("clusters", 2), ("copies", 64)])
def test_recall_against_brute_force(spark, shape, coarse, monkeypatch):
    monkeypatch.setattr(N, "PART", 500)
    monkeypatch.setattr(N, "BLOCK", 20)
    monkeypatch.setattr(N, "COARSE", coarse)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    if shape == "clusters":
        x = x * 0.2 + rng.normal(size=(10, 16))[rng.integers(0, 10, 1500)]
    if shape == "copies":
        x[:700] = x[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    got = {}
    for r in N.search(table, table.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, range(0, 1500, 20), 20)
    assert set(got) == set(want)
    hit = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]
    assert np.mean(hit) >= 0.9
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda t: (-t[1], t[0]))
    if shape == "copies":
        assert [v for v, _ in got[0]] == [v for v, _ in want[0]]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 1.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (0, [1.0, 0.0])]
    table = spark.createDataFrame(rows, SCHEMA)
    got = N.search(table, table.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in got] == [(0, 1, 7, 1.0), (0, 2, 7, 1.0), (0, 3, 20, 0.5), (20, 1, 7, 1.5), (20, 2, 7, 1.5), (20, 3, 0, 0.5), (20, 4, 0, 0.5)]
    assert N.search(table.limit(0), table, 20).count() == 0


def test_the_sample_is_bounded_and_cells_grow(spark, monkeypatch):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(4000, 8)))], SCHEMA)
    monkeypatch.setattr(N, "SAMPLE", 500)
    few, many = (N.build(*N._vectors(table.where(f"vec_id < {n}"))) for n in (1000, 4000))
    assert len(few.first) == 4 and len(many.first) == 9 and many.count.sum() == 4000 == many.coarse[2].sum()


def test_the_query_against_brute_force(spark):
    """op5_nearest on the whole table: recall of at least 0.9, exact scores, nearest first."""
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = {}
    for r in N.op5_nearest(spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    assert np.mean([len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9
    x = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(abs(float(x[q] @ x[v]) - s) < 1e-9 and v != q for _, v, s in found)
