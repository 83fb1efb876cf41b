from decimal import Decimal

import __spark_entry__ as entry
import duckdb
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from sparkweft.functions import schema as S
from sparkweft.plans import catalog, star
from sparkweft.streaming.ingest import ingest_edges, ingest_nodes, stored_graph, windowed_counts

SF = "/root/testdata/sf0.001"


def test_every_query_has_a_callable_and_sql_belongs_to_one():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(q) for q in entry.queries().values())


def test_flagship(spark):
    rows = entry.entry(spark).groupBy("hop").count().collect()
    assert {r.hop: r["count"] for r in rows} == {0: 1, 1: 12, 2: 48}


def test_the_stored_graph_is_the_built_one(spark):
    kept, made = star.graph(spark, SF), star.built(spark, SF)
    key = lambda g: (sorted(map(str, g.nodes.select(*made.nodes.columns).collect())), sorted(map(str, g.edges.select(*made.edges.columns).collect())))
    assert key(kept) == key(made)
    plan = kept.edges.where("source = 'file:c0' AND type = 'IMPORTS'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(type" in plan and "EqualTo(source,file:c0)" in plan


def test_queries_against_duckdb(spark):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    con.execute("SET TimeZone = 'UTC'")
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    for name in catalog.oracle_sql():
        got = catalog.queries()[name](spark, SF)
        names = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(names)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        rows = lambda found: sorted(str(tuple(plain(float(x) if isinstance(x, Decimal) else x) for x in r)) for r in found)
        assert rows(got.select(*names).collect()) == rows(want), name


def test_streams(spark, tmp_path):
    g = star.graph(spark, SF)
    top = g.nodes.where("type IN ('Directory', 'Repository')")
    held = g.edges.where("type = 'CONTAINS' AND source LIKE 'repo:%'").select(*(c.split()[0] for c in S.EDGES.replace(S.LOCATION, "location").split(", ")))
    g.nodes.where("type = 'Directory'").write.parquet(f"{tmp_path}/in/a")
    top.write.parquet(f"{tmp_path}/in/b")
    held.write.parquet(f"{tmp_path}/in/edges")
    store = f"{tmp_path}/store"
    with pytest.raises(StreamingQueryException, match="does not exist"):
        ingest_edges(spark, f"{tmp_path}/in/edges", store, f"{tmp_path}/check-early").awaitTermination()
    for part in "ab":
        ingest_nodes(spark, f"{tmp_path}/in/{part}", store, f"{tmp_path}/check{part}").awaitTermination()
    assert stored_graph(spark, store).number_of_nodes() == 30
    for _ in range(2):  # the second time there is nothing new
        ingest_edges(spark, f"{tmp_path}/in/edges", store, f"{tmp_path}/check-edges").awaitTermination()
    stored = stored_graph(spark, store)
    assert stored.number_of_edges() == 25 and {r.asDict()["id"] for r in stored.nodes.collect()} == {r.id for r in top.collect()}
    # A stream of its own, with a checkpoint of its own, adds to the store and does not begin it anew.
    more = g.nodes.where("id = 'file:c1'")
    more.write.parquet(f"{tmp_path}/in/c")
    ingest_nodes(spark, f"{tmp_path}/in/c", store, f"{tmp_path}/checkc").awaitTermination()
    assert stored_graph(spark, store).number_of_nodes() == 31
    more.withColumn("name", F.lit("another")).write.parquet(f"{tmp_path}/in/d")
    with pytest.raises(StreamingQueryException, match="other values"):
        ingest_nodes(spark, f"{tmp_path}/in/d", store, f"{tmp_path}/checkd").awaitTermination()
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert windowed_counts(events).agg({"n": "sum"}).first()[0] == events.count()


def test_a_stream_of_events_is_counted_like_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    key = lambda df: sorted((r.start, r.event_type, r.n, round(r.total, 4)) for r in df.collect())
    assert key(spark.table("counted")) == key(windowed_counts(events))


PLANNED = [
    "build_violations", "callers", "dangling_edges", "derive_depends_on", "edge_order", "expand_context_edges", "expand_context_nodes", "graph_aware_rank", "graph_json_round_trip",
    "label_layers", "multi_hop_2_both", "multi_hop_batch", "multipartite_layout", "shortest_path_contains", "shortest_path_length", "structural_retrieval", "synthetic_nodes",
    "validation_issues", "visible_subgraph", "build_graph", "find_path",
]


@pytest.mark.parametrize("name", PLANNED)
def test_large_tables_are_planned_and_never_stored(spark, monkeypatch, tmp_path, name):
    monkeypatch.setattr(star, "STORED", 0)
    monkeypatch.setattr(star, "stored", None)
    con = duckdb.connect()
    for t in star.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = catalog.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted(str(tuple(round(float(x), 6) if isinstance(x, (float, Decimal)) else x for x in r)) for r in rows)
    assert plain(got.select(*names).collect()) == plain(want)
