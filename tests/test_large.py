"""Plans that keep large graphs off the disk, with the same rows."""

import pytest
from pyspark.sql import functions as F

from sparkweft.functions import lineage
from sparkweft.functions import schema as S
from sparkweft.operators import build, depends, layout, query, retrieve, traverse, validate
from sparkweft.operators.graph import PropertyGraph
from sparkweft.plans import star
from sparkweft.sources import graph_io

SF = "/root/testdata/sf0.001"


@pytest.fixture
def large(monkeypatch, spark):
    """A planned graph, with filters of no identifiers and passes over a few rows."""
    for module in (query, traverse):
        monkeypatch.setattr(module, "LISTED", 0)
    monkeypatch.setattr(lineage, "AT_ONCE", 5000)
    return star.built(spark, SF, derived=False)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(df) -> list:
    return sorted(tuple(r) for r in df.select("source", "target", "type").collect())


def test_dependencies_shuffle_types_and_no_sets(large):
    plan = depends.file_dependencies(large.edges)._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_set" in plan and plan.index("partial_collect_set") < plan.index("REPARTITION_BY_COL")  # printed from the top


def test_induced_edges_are_not_shuffled(spark, large):
    gone = large.nodes.where("is_synthetic OR id = 'dir:3'").select("id")
    ids = large.nodes.join(gone, "id", "left_anti").select("id")
    found = query.induced(large.edges.where("type <> 'INHERITS'"), ids)
    assert "LeftSemi" not in _plan(found)
    lost = {r.id for r in gone.collect()}
    assert _rows(found) == [r for r in _rows(large.edges) if r[2] != "INHERITS" and not lost & {r[0], r[1]}]
    made = spark.createDataFrame([("a", "b"), ("a", None), ("c", "a"), ("b", "a")], "source string, target string").withColumn("type", F.lit("CALLS"))
    assert _rows(query.induced(made, spark.createDataFrame([("a",), ("b",), ("b",)], "id string"))) == [("a", "b", "CALLS"), ("b", "a", "CALLS")]


def test_edges_that_touch_nodes(spark, large):
    gone = large.nodes.where("id IN ('dir:3', 'file:s1')").select("id")
    want = [r for r in _rows(large.edges) if {r[0], r[1]} & {"dir:3", "file:s1"}]
    assert want and _rows(query.touching(large.edges, gone.union(gone))) == want


def test_validation_does_not_shuffle_the_edges(spark, large):
    broken = PropertyGraph(large.nodes.where("id <> 'dir:3'").withColumn("is_synthetic", F.lit(False)), large.edges)
    issues = validate.validation_issues(broken)
    assert "join" not in _plan(issues).lower() or "rightHint=(strategy=broadcast)" in _plan(issues)
    got = sorted((r.category, r.element_id) for r in issues.where("category IN ('missing_source', 'missing_target', 'unresolved_reference')").collect())
    name = lambda r: f"rel:{r[2].lower()}:{r[0]}->{r[1]}"
    edges = _rows(large.edges)
    want = [("missing_source", name(r)) for r in edges if r[0] == "dir:3"] + [("missing_target", name(r)) for r in edges if r[1] == "dir:3"]
    assert got == sorted(want + [("unresolved_reference", name(r)) for r in edges if r[1].startswith("unresolved:")])


def test_a_small_front_filters_steps_below_their_shuffles(spark, large):
    front = large.nodes.where("type = 'File'").select("id")
    after = traverse._after(front, front.count(), traverse._steps(large, None, "out"))
    assert "LeftSemi" in _plan(after)
    inside = {r.id for r in front.collect()}
    assert sorted(r.to for r in after.collect()) == sorted(r[1] for r in _rows(large.edges) if r[0] in inside)


def test_levels_keep_containment_without_a_shuffle(large, monkeypatch):
    plans = []
    monkeypatch.setattr(layout, "kept", lambda df: plans.append(_plan(df)) or lineage.kept(df))
    twice = PropertyGraph(large.nodes, large.edges.union(large.edges))
    assert sorted(layout.node_levels(twice).collect()) == sorted(layout.node_levels(large).collect())
    assert not plans[0].startswith("Aggregate")


@pytest.fixture
def plain(spark):
    """Plans as they are before they run, with reused exchanges."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString().splitlines()
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_all_edges_share_one_shuffle_by_order(spark, large, plain, monkeypatch):
    lines = plain(large.edges.select("source", "target", "type"))
    assert sum("Exchange hashpartitioning(l_orderkey" in x and "Reused" not in x for x in lines) == 1
    monkeypatch.setattr(star, "KEYS", 0)  # tables of keys that are too large to send
    assert _rows(star.built(spark, SF, derived=False).edges) == _rows(large.edges)


def test_filters_of_both_ends_go_below_the_shuffles(spark, large, plain):
    ids = large.nodes.where("type = 'File'").select("id")
    found = query.induced(large.edges.where("type = 'CALLS'"), ids, ids.count())
    lines = plain(found.select("source", "target"))
    below = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(l_orderkey" in x]
    assert below and all("LeftSemi" in "".join(lines[i + 1 : i + 4]) for i in below)


def test_levels_of_paths_are_shuffled_without_their_paths(spark, large, monkeypatch):
    want = sorted((r.id, r.depth, list(r.path)) for r in traverse.shortest_paths(large, "repo:1", ["CONTAINS"]).collect())
    plans = []
    monkeypatch.setattr(traverse, "kept", lambda df: plans.append(_plan(df)) or lineage.kept(df))
    monkeypatch.setattr(traverse, "SENT", 40)  # files are more, and so are what they hold
    got = sorted((r.id, r.depth, list(r.path)) for r in traverse.shortest_paths(large, "repo:1", ["CONTAINS"]).collect())
    assert got == want and max(x[1] for x in got) == 3
    levels = [p for p in plans if "min(struct" in p]
    assert "parent" in levels[0] and not any("path" in x.split("min(struct")[1].split(")")[0] for x in levels[0].splitlines() if "min(struct" in x)


def test_nodes_that_lead_nowhere_are_no_front(spark, large, monkeypatch):
    monkeypatch.setattr(traverse, "SENT", 200)
    fronts = []
    monkeypatch.setattr(traverse, "_after", lambda front, n, steps, after=traverse._after: fronts.append(n) or after(front, n, steps))
    found = traverse.shortest_paths(large, "repo:1", ["CONTAINS"])
    deepest = found.where("depth = 3").count()
    assert deepest > 200 and len(fronts) == 3 and max(fronts) < deepest  # classes and functions contain nothing


def test_seeds_with_enough_nodes_go_no_further(spark, large):
    questions = large.nodes.where("type = 'Directory'").select(F.expr("CAST(substr(id, 5) AS int)").alias("query_id"), "name").withColumnRenamed("name", "text")
    seeds = large.nodes.where("type = 'Directory'").select(F.col("id").alias("seed"))
    all_ = traverse.hops(large, seeds, 2, None, "out", False).collect()
    some = traverse.hops(large, seeds, 2, None, "out", False, enough=3).collect()
    held = {r.id: sum(x.seed == r.id and x.hop < 2 for x in all_) for r in large.nodes.where("type = 'Directory'").collect()}
    assert {tuple(r) for r in some} == {tuple(r) for r in all_ if r.hop < 2 or held[r.seed] < 3} and len(some) < len(all_)
    none = spark.createDataFrame([("file:c0",)], "id string")
    assert len(traverse.hops(large, seeds, 2, None, "out", False, enough=3, among=none).collect()) == len(all_)  # none has three of these
    best = {}
    for r in sorted(all_, key=lambda r: (r.hop, r.id)):
        best.setdefault(int(r.seed[4:]), []).append((r.id, round(1 / (1 + r.hop), 6)))
    got = {}
    for r in retrieve.structural(large, questions, 4, 2, direction="out").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.entity_id, round(r.score, 6)))
    assert got == {k: v[:4] for k, v in best.items()}


def test_tables_are_stored_without_what_follows(spark, large, tmp_path):
    odd = [
        ("a", "b", "k", None, "CALLS", None, "{}", False, True, False, None, 3),
        ("a", "b", "rel:calls:a->b", "rel:calls:a->b", "CALLS", None, None, False, True, False, None, None),
        ("a", "b", "mine", "mine", "CALLS", None, "{}", False, True, False, "{}", 5),
        ("b", "a", "other", "rel:holds:b->a", "HOLDS", None, "{}", None, None, None, None, 6),
        ("b", "a", "untyped", "untyped", None, None, "{}", False, False, False, None, 7),
    ]
    edges = large.edges.unionByName(spark.createDataFrame(odd, S.EDGES))
    nodes = large.nodes.withColumn("node_ord", F.when(F.col("type") != "File", F.col("node_ord")))
    for at_once in (False, True):
        path = f"{tmp_path}/{at_once}"
        graph_io.save_tables(PropertyGraph(nodes, edges, {"a": 1}), path, at_once)
        stored = spark.read.parquet(f"{path}/edges")
        assert stored.where("id IS NOT NULL OR key IS NOT NULL OR edge_ord IS NOT NULL").count() <= len(odd)
        back = graph_io.load_tables(spark, path)
        assert back.metadata == {"a": 1} and back.nodes.columns == nodes.columns and back.edges.columns == edges.columns
        for given, got in ((nodes, back.nodes), (edges, back.edges)):
            assert given.exceptAll(got).isEmpty() and got.exceptAll(given).isEmpty()
    # Tables of before hold every value.
    large.nodes.write.parquet(f"{tmp_path}/old/nodes")
    large.edges.write.partitionBy("type").parquet(f"{tmp_path}/old/edges")
    spark.createDataFrame([("{}",)], "metadata string").write.json(f"{tmp_path}/old/metadata")
    assert graph_io.load_tables(spark, f"{tmp_path}/old").edges.exceptAll(large.edges).isEmpty()


def test_built_graphs_keep_identifiers_alone(spark, large, monkeypatch):
    wide = []
    for name in ("cut", "kept"):
        monkeypatch.setattr(build, name, lambda df, keep=getattr(lineage, name): wide.append(df.columns) or keep(df), raising=False)
    entities = large.nodes.where("NOT is_synthetic").select("id", "type", "name", "path", "location", "properties", F.col("node_ord").alias("ord"))
    relationships = large.edges.select("id", "source", "target", "type", "location", "properties", F.abs("edge_ord").alias("ord"))
    graph = build.from_tables(entities, relationships)
    assert wide and not any({"name", "location"} & set(columns) for columns in wide)
    assert _rows(graph.edges) == _rows(large.edges)
    assert sorted(r.id for r in graph.nodes.select("id").collect()) == sorted(r.id for r in large.nodes.collect())
    # Rows in doubt: a repeated node and edge, an edge whose target is only a later placeholder, and one without its source.
    more = spark.createDataFrame([("file:x", "File", "x", "x", None, "{}", 1), ("file:x", "File", "x", "x", None, "{}", 2), (None, "File", "y", "y", None, "{}", 3)], build.ENTITIES)
    edge = lambda id_, source, target, ord_, properties="{}": (id_, source, target, "CALLS", None, properties, ord_)
    rows = [edge("a", "file:x", "file:c0", 1), edge("a", "file:x", "file:c0", 2), edge("b", "file:x", "late", 5), edge("c", "file:x", "late", 6, '{"resolved":false}'), edge("d", "gone", "file:c0", 7), edge("e", "file:x", "late", 8)]
    some, edges = entities.union(more), relationships.union(spark.createDataFrame(rows, build.RELATIONSHIPS))
    first = build.violations(some, build.flagged(edges)).orderBy("phase", "ord", "rank").collect()
    assert [(r.error, r.ord) for r in first] == [("ValueError", 3), ("NodeNotFoundError", 5), ("NodeNotFoundError", 7)]
    with pytest.raises(ValueError, match="'None'"):
        build.from_tables(some, edges)
    with pytest.raises(S.NodeNotFoundError, match="'late'"):
        build.from_tables(some.where("id IS NOT NULL"), edges)
    free = build.from_tables(some, edges, check=False)
    assert free.edges.count() == large.edges.count() + 5 and free.nodes.count() == large.nodes.count() + 3
