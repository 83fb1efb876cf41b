import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from sparkweft.functions import schema as S
from sparkweft.operators import build, layout, query, retrieve, traverse, validate
from sparkweft.operators.chunk import HashingEmbedder, chunk_analysis, chunk_graph, embed, load_index, save_index
from sparkweft.operators.graph import PropertyGraph
from sparkweft.sources import graph_io
from sparkweft.sources.analyzer import analyze_repository
from tests import samples


@pytest.fixture(scope="module")
def analysis(spark, tmp_path_factory):
    return analyze_repository(spark, str(samples.write(tmp_path_factory.mktemp("tree") / "pottery")))


@pytest.fixture(scope="module")
def document(analysis):
    return analysis.to_dict()


@pytest.fixture(scope="module")
def graph(spark, document):
    return build.build_from_analysis(spark, document, on_missing="placeholder").kept()


def ids(df):
    return [r.id for r in df.collect()]


def entity(i, kind="Function", name="f", **more):
    return {"id": i, "type": kind, "name": name, "properties": {}, **more}


def relation(s, t, kind="CALLS", **more):
    return {"id": f"{s}->{t}", "source": s, "target": t, "type": kind, "properties": {}, **more}


def test_types():
    assert S.node_type("unresolved_reference") == S.node_type("UnresolvedReference") == "UnresolvedReference"
    assert S.relationship_type("depends_on") == "DEPENDS_ON"
    for check, error in ((S.node_type, S.InvalidNodeTypeError), (S.relationship_type, S.InvalidRelationshipTypeError)):
        with pytest.raises(error):
            check("Variable")
        assert issubclass(error, ValueError)


def test_add_node_and_relationship(spark):
    g = PropertyGraph.empty(spark, {"a": 1}).add_node("a", "function", "A", path="p").add_node("b", "Class", "B", weight=2)
    assert g.get_node("a") == {"id": "a", "type": "Function", "name": "A", "path": "p"} and g.get_node("b")["weight"] == 2
    assert g.has_node("a") and not g.has_node("x") and not g.has_node(None) and g.get_node("x") is None
    for bad in ({"node_id": " ", "name": "x"}, {"node_id": "x", "name": ""}):
        with pytest.raises(ValueError):
            g.add_node(node_type="Class", **bad)
    with pytest.raises(S.NodeAlreadyExistsError):
        g.add_node("a", "Function", "A")
    with pytest.raises(S.NodeAlreadyExistsError):
        g.add_node("a", "Function", "other", raise_if_exists=False)
    assert g.add_node("a", "Function", "A", raise_if_exists=False, raw_call="r").get_node("a")["raw_call"] == "r"
    with pytest.raises(S.NodeNotFoundError):
        g.add_relationship("a", "x", "CALLS")
    g = g.add_relationship("a", "b", "calls", id="r1").add_relationship("a", "b", "IMPORTS").add_relationship("a", "b", "IMPORTS")
    assert g.number_of_edges() == 2 and g.has_relationship("a", "b", "imports") and not g.has_relationship("b", "a", "nonsense")
    assert g.get_relationship("a", "b", "CALLS")["key"] == "r1" and g.get_relationship("a", "b", "x", key="IMPORTS")["type"] == "IMPORTS"
    with pytest.raises(S.RelationshipAlreadyExistsError):
        g.add_relationship("a", "b", "CALLS", key="r1", id="r1", properties={"x": 1}).add_relationship("a", "b", "CALLS", key="r1", properties={"x": 2})
    assert g.clear().number_of_nodes() == 0 and g.clear().metadata == {"a": 1}


def test_golden_graph(graph):
    stats = query.get_statistics(graph)
    assert stats["entities_by_type"] == {"Class": 4, "Directory": 3, "File": 7, "Function": 8, "Method": 5, "Repository": 1, "UnresolvedReference": 14}
    assert stats["relationships_by_type"] == {"CALLS": 17, "CONTAINS": 27, "DEPENDS_ON": 4, "IMPORTS": 9, "INHERITS": 2}
    assert (stats["total_nodes"], stats["total_edges"], stats["primitive_relationship_count"], stats["derived_relationship_count"], stats["unresolved_calls_count"]) == (42, 59, 55, 4, 9)
    node = graph.get_node("unresolved:aio.sleep")
    assert node["is_synthetic"] and not node["resolved"] and node["raw_call"] == node["name"] == "aio.sleep"
    assert graph.get_relationships("file:setup_kiln.py", "file:kiln/tools/timer.py").count() == 3
    assert validate.validate_or_raise(graph).summary() == "Validation PASSED: 0 error(s), 0 warning(s)."


@pytest.mark.parametrize(("entities", "relationships", "error", "message"), [
    ([entity("m", "Module")], [], S.KnowledgeGraphError, "Module entities are deprecated in v2.0"),
    ([entity("a")], [relation("x", "a")], S.NodeNotFoundError, "Source entity 'x' does not exist"),
    ([entity("a")], [relation("a", "x")], S.NodeNotFoundError, "Target entity 'x' does not exist"),
    ([entity("a", "Variable")], [], S.InvalidNodeTypeError, "Variable"),
    ([entity("a"), entity("b")], [relation("a", "b", "BELONGS_TO")], S.InvalidRelationshipTypeError, "BELONGS_TO"),
    ([entity("a"), entity("a", name="g")], [], S.NodeAlreadyExistsError, "'a'"),
    ([entity("a", name=" ")], [], ValueError, "blank"),
    ([entity("a"), entity("b")], [relation("a", "b"), relation("a", "b", properties={"x": 1})], S.RelationshipAlreadyExistsError, "a->b"),
    ([entity("a")], [relation("unresolved:q", "a"), relation("a", "unresolved:q")], S.NodeNotFoundError, "Source entity 'unresolved:q'"),
])
def test_rules_of_the_builder(spark, entities, relationships, error, message):
    with pytest.raises(error, match=message.replace("(", r"\(")):
        build.build_from_analysis(spark, {"entities": entities, "relationships": relationships})


def test_options_of_the_builder(spark):
    doc = {"entities": [entity("a"), entity("a")], "relationships": [relation("a", "module:os", "IMPORTS"), relation("a", "unresolved:z", properties={"raw_call": "zz"}), relation("a", "unresolved:z")]}
    doc["relationships"][2]["id"] = "other"
    with pytest.raises(S.NodeNotFoundError):
        build.build_from_analysis(spark, doc)
    dropped = build.build_from_analysis(spark, json.dumps(doc), on_missing="drop")
    assert sorted(ids(dropped.nodes)) == ["a", "unresolved:z"] and dropped.get_node("unresolved:z")["name"] == "zz"
    assert build.build_from_analysis(spark, doc, on_missing="placeholder").number_of_nodes() == 3
    with pytest.raises(S.NodeAlreadyExistsError):
        build.build_from_analysis(spark, doc, strict_duplicates=True, on_missing="drop")
    for bad, error in ((3, TypeError), ("nowhere.json", FileNotFoundError), ({"entities": [{"id": 5, "type": "File", "name": "x"}]}, ValueError)):
        with pytest.raises(error):
            build.build_from_analysis(spark, bad)


def test_traversal(graph):
    timer = "kiln/tools/timer.py"
    assert ids(traverse.get_callers(graph, "func:kiln/glaze.py:coat")) == ["func:setup_kiln.py:start"]
    assert ids(traverse.get_callees(graph, "func:setup_kiln.py:start", include_unresolved=False)) == [f"class:{timer}:Timer", "func:kiln/glaze.py:coat", f"func:{timer}:wait"]
    assert ids(traverse.get_dependencies(graph, "file:setup_kiln.py")) == ["file:kiln/glaze.py", f"file:{timer}"] == ids(traverse.get_dependencies(graph, "file:setup_kiln.py", []))
    assert ids(traverse.get_dependents(graph, "file:kiln/glaze.py")) == ["file:kiln/fire.py", "file:setup_kiln.py"]
    assert ids(traverse.get_neighbors(graph, "file:setup_kiln.py", rel_types=[])) == []
    path = ["repo:pottery", "dir:kiln", "dir:kiln/tools", f"file:{timer}", f"class:{timer}:Timer", f"method:{timer}:Timer.__init__"]
    assert traverse.find_path(graph, path[0], path[-1], ["CONTAINS"]) == path
    assert traverse.find_path(graph, path[-1], path[0]) is None and traverse.find_path(graph, path[0], path[-1], ["CONTAINS"], 4) is None
    assert traverse.find_path(graph, path[0], path[0]) == path[:1]
    with pytest.raises(S.NodeNotFoundError):
        traverse.find_path(graph, "x", path[0])
    with pytest.raises(ValueError):
        traverse.get_neighbors(graph, path[0], "up")
    found = traverse.expand_context(graph, "file:setup_kiln.py", 1)
    assert set(ids(found.nodes)) == {"file:setup_kiln.py", "repo:pottery", "func:setup_kiln.py:start", "file:kiln/glaze.py", f"file:{timer}"} and found.edges.count() == 7
    assert {r.hop for r in traverse.multi_hop_traversal(graph, ["file:setup_kiln.py"], 0).collect()} == {0}
    assert query.find_nodes_by_name(graph, "I", "method", exact=False).count() == 3
    assert query.visible(graph, hide_unresolved=True, hide_derived=True).edges.count() == 40


def _bfs(edges, seeds, hops, direction):
    seen, front = {s: 0 for s in seeds}, set(seeds)
    for hop in range(1, hops + 1):
        front = {t for s, t in edges if s in front and direction != "in"} | {s for s, t in edges if t in front and direction != "out"}
        front -= set(seen)
        seen |= dict.fromkeys(front, hop)
    return seen


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.sampled_from(traverse.DIRECTIONS), st.integers(0, 3))
def test_hops_of_random_graphs(spark, seed, direction, n):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(12)]
    nodes = spark.createDataFrame([(f"n{i}", "Function", "x", None, None, "{}", False, True, None, None, i) for i in range(9)], S.NODES)
    rows = spark.createDataFrame([(s, t, str(i), str(i), "CALLS", None, "{}", False, True, False, None, i) for i, (s, t) in enumerate(edges)], S.EDGES)
    got = {r.id: r.hop for r in traverse.multi_hop_traversal(PropertyGraph(nodes, rows), ["n0", "n1"], n, direction=direction).collect()}
    assert got == _bfs(edges, ["n0", "n1"], n, direction)


def test_validation_finds_what_is_broken(spark):
    nodes = spark.createDataFrame([("m", "Module", "m", None, None, "{}", False, True, None, None, 0), ("f", "Function", "f", None, None, "{}", False, True, None, None, 1), ("s", "Class", "s", None, None, "{}", True, True, None, None, 2)], S.NODES)
    edges = spark.createDataFrame([("f", "m", "1", "1", "CALLS", None, "{}", False, True, True, None, 0), ("f", "gone", "2", "2", "odd", None, "{}", False, True, False, None, 1), ("m", "f", "3", "3", "DEFINED_IN", None, "{}", False, False, False, None, 2)], S.EDGES)
    report = validate.validate_graph(PropertyGraph(nodes, edges))
    found = sorted((r.category, r.element_id) for r in report.issues.collect())
    assert found == [("deprecated_relationship", "3"), ("entity_type", "m"), ("missing_target", "2"), ("module_entity", "m"), ("relationship_type", "2"), ("synthetic_node", "s"), ("synthetic_node", "s"), ("unresolved_reference", "1")]
    with pytest.raises(S.KnowledgeGraphError, match="validation failed"):
        validate.validate_or_raise(PropertyGraph(nodes, edges))


def test_files_round_trip(spark, graph, tmp_path):
    key = lambda g: (sorted((r.id, r.type, r.name, r.path, r.properties, r.is_synthetic) for r in g.nodes.collect()), sorted((r.source, r.target, r.key, r.type, r.properties, r.is_derived) for r in g.edges.collect()))
    text = graph_io.export_json(graph, tmp_path / "a" / "g.json")
    assert [n["id"] for n in json.loads(text)["nodes"]] == sorted(ids(graph.nodes))
    for back in (graph_io.import_json(spark, text), graph_io.import_json(spark, tmp_path / "a" / "g.json")):
        assert key(back) == key(graph) and back.metadata == json.loads(json.dumps(graph.metadata))
    graph_io.export_graphml(graph, tmp_path / "g.graphml")
    back = graph_io.import_graphml(spark, tmp_path / "g.graphml")
    assert (back.number_of_nodes(), back.number_of_edges()) == (42, 59) and back.metadata["stats"] == graph.metadata["stats"]
    graph_io.save_tables(graph, str(tmp_path / "t"))
    assert key(graph_io.load_tables(spark, str(tmp_path / "t"))) == key(graph)
    with pytest.raises(FileNotFoundError):
        graph_io.import_json(spark, "none.json")


def test_upsert(spark, graph):
    with pytest.raises(S.NodeAlreadyExistsError):
        build.upsert(graph, graph.nodes.limit(1).selectExpr("id", "type", "'x' AS name", "path", "location", "properties", "is_synthetic", "resolved", "raw_call", "extra", "node_ord"))
    assert build.upsert(graph, graph.nodes, graph.edges).number_of_edges() == 59


def test_chunks_and_search(spark, analysis, document, graph, tmp_path):
    chunks = chunk_analysis(spark, document, analysis.contents)
    rows = {r.entity_id: r for r in chunks.collect()}
    assert len(rows) == 24 == chunk_graph(graph, analysis.contents).count()
    method = rows["method:kiln/fire.py:Kiln.Door.open"]
    assert method.signature == "open(self)" and method.source_code.startswith("        def open") and method.qualified_name == "Kiln.Door.open"
    assert method.text_representation.startswith("Entity Type: Method\nName: open\nQualified Name: Kiln.Door.open\nFile: kiln/fire.py\nSignature: open(self)\nSource Code:\n")
    assert rows["class:kiln/glaze.py:Glaze"].signature == "class Glaze(fire.Kiln, dict)" and rows["file:kiln/glaze.py"].signature == "glaze.py"
    index = embed(chunks, HashingEmbedder(64))
    save_index(index, str(tmp_path / "index"))
    index = load_index(spark, str(tmp_path / "index"))
    query_vector = HashingEmbedder(64)([method.text_representation])[0]
    assert retrieve.search(index, query_vector, 1).first().entity_id == method.entity_id
    assert {r.entity_type for r in retrieve.search(index, query_vector, 50, "CLASS").collect()} == {"class"}
    made = spark.createDataFrame([("a", "function", [1.0, 0.0]), ("b", "class", [0.0, 1.0]), ("c", "method", [0.6, 0.8])], "entity_id string, entity_type string, embedding array<float>")
    got = retrieve.search(made, [2.0, 0.0], 10).collect()
    assert [(r.entity_id, round(r.score, 6)) for r in got] == [("a", 1.0), ("c", 0.6), ("b", 0.0)] and retrieve.search(made, [1.0, 0.0], 0).count() == 0
    with pytest.raises(ValueError):
        retrieve.add_chunks(None, chunks)


def test_layout(graph):
    places = {r.id: (r.x, round(r.y, 6)) for r in layout.compute_layout(graph).collect()}
    assert places["repo:pottery"] == (0.0, 0.0) and places["dir:kiln"][1] == -2.4 and places["unresolved:max"][1] == -12.0
    assert len(places) == 42
    with pytest.raises(ValueError):
        layout.compute_layout(graph, "spring")


def _levels(nodes, edges):
    """By hand: least distance over CONTAINS from what nothing contains, else 5 for synthetic nodes, else by type, 2 for others."""
    held = {(s, t) for s, t, k in edges if k == "CONTAINS"}
    inside = {x for e in held for x in e}
    roots = [n for n in inside if not any(t == n for _, t in held)] or [n for n in nodes if not any(t == n for _, t, _ in edges)] or [next(iter(nodes))]
    near, front, hop = dict.fromkeys(roots, 0), set(roots), 0
    while front:
        hop += 1
        front = {t for s, t in held if s in front} - set(near)
        near |= dict.fromkeys(front, hop)
    fallback = {"Repository": 0, "Directory": 1, "File": 2, "Class": 3, "Function": 3, "Method": 4}
    return {n: near[n] if n in near and n in inside else 5 if synthetic else fallback.get(kind, 2) for n, (kind, synthetic) in nodes.items()}


def _places(nodes, edges):
    levels, at = _levels(nodes, edges), {}
    for level in range(max(levels.values()) + 1):
        def mean(n):
            held = [at[s][0] for s in sorted({s for s, t, k in edges if t == n and k == "CONTAINS"}) if s in at]
            near = held or [at[s][0] for s, t, _ in edges if t == n and s in at]
            return (sum(near) / len(near) if near else 0.0, n)

        here = sorted((n for n in nodes if levels[n] == level), key=mean)
        at |= {n: ((i - (len(here) - 1) / 2) * 3.0, -level * 2.4) for i, n in enumerate(here)}
    return at


@pytest.mark.parametrize("seed", range(5))
def test_layouts_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    kinds = ["Repository", "Directory", "File", "Class", "Function", "Method", "Module", "UnresolvedReference"]
    nodes = {f"n{i:02}": (k := rng.choice(kinds), k == "UnresolvedReference" or rng.random() < 0.1) for i in range(18)}
    edges = [(f"n{rng.randrange(18):02}", f"n{rng.randrange(18):02}", "CONTAINS" if rng.random() < 0.6 else "CALLS") for _ in range(16)]
    if seed == 0:
        edges = [("n00", "n01", "CONTAINS"), ("n01", "n00", "CONTAINS"), ("n01", "n02", "CONTAINS"), ("n03", "n00", "CALLS")]
    if seed == 1:  # a chain deeper than any table of types
        nodes = {f"n{i:02}": ("Directory", False) for i in range(70)}
        edges = [(f"n{i:02}", f"n{i + 1:02}", "CONTAINS") for i in range(69)]
    table = spark.createDataFrame([(n, k, n, None, None, "{}", s, not s, None, None, i) for i, (n, (k, s)) in enumerate(nodes.items())], S.NODES)
    rows = spark.createDataFrame([(s, t, str(i), str(i), k, None, "{}", False, True, False, None, i) for i, (s, t, k) in enumerate(edges)], S.EDGES)
    g = PropertyGraph(table, rows)
    assert {r.id: r.level for r in layout.node_levels(g).collect()} == _levels(nodes, edges)
    if seed != 1:
        got = {r.id: (round(r.x, 9), round(r.y, 9)) for r in layout.hierarchical_layout(g).collect()}
        assert got == {n: (round(x, 9), round(y, 9)) for n, (x, y) in _places(nodes, edges).items()}
    got = {r.id: r.y for r in layout.multipartite_layout(g).collect()}
    for kind in {k for k, _ in nodes.values()}:
        column = sorted(n for n, (k, _) in nodes.items() if k == kind)
        assert [got[n] for n in column] == [i - (len(column) - 1) / 2 for i in range(len(column))]


def test_drawing(spark, graph, tmp_path):
    import xml.etree.ElementTree as ET

    from sparkweft.operators import draw

    text = draw.visualize_graph(graph, tmp_path / "deep" / "g.svg", title="Pots & kilns", hide_derived=True)
    assert (tmp_path / "deep" / "g.svg").read_text(encoding="utf-8") == text
    root, space = ET.fromstring(text), {"s": "http://www.w3.org/2000/svg"}
    assert len(root.findall(".//s:g[@class='node']", space)) == 42 and len(root.findall(".//s:path[@class='edge']", space)) == 55
    shown = "".join(root.itertext())
    assert "Pots & kilns" in shown and "42 nodes (28 repository entities, 14 placeholders), 55 relationships" in shown
    assert "? aio.sleep" in shown and "coat()" in shown and "CALLS" in shown and "DEPENDS_ON" not in shown
    assert {t.text for t in root.findall(".//s:g[@class='legend']/s:text", space)} == {"Repository", "Directory", "File", "Class", "Function", "Method", "UnresolvedReference", "CONTAINS", "CALLS", "IMPORTS", "INHERITS"}
    assert "No nodes" in draw.svg(graph.clear())
    saved = tmp_path / "g.json"
    graph_io.export_json(graph, saved)
    for source in (saved, str(saved), saved.read_text(), json.loads(saved.read_text())):
        assert draw.as_graph(spark, source).number_of_nodes() == 42
    assert draw.as_graph(spark, graph) is graph
    with pytest.raises(TypeError):
        draw.as_graph(spark, 3)


def test_command_lines(spark, tmp_path, capsys):
    from sparkweft import cli

    root = samples.write(tmp_path / "pottery")
    assert cli.main(["analyze", "--repo-dir", str(root), "--output", str(tmp_path / "out" / "a.json")]) == 0
    told = capsys.readouterr().out
    assert "total_entities: 28" in told and "canonical hash:" in told
    document = json.loads((tmp_path / "out" / "a.json").read_text())
    assert len(document["relationships"]) == 59 and "extracted_at" in document["metadata"]
    assert cli.main(["analyze", "--repo-dir", str(root), "--output", str(tmp_path / "c.json"), "--no-derived", "--canonical-only"]) == 0
    document = json.loads((tmp_path / "c.json").read_text())
    assert len(document["relationships"]) == 55 and "extracted_at" not in document["metadata"]
    g = build.build_from_file(spark, tmp_path / "out" / "a.json", on_missing="placeholder")
    graph_io.export_json(g, tmp_path / "g.json")
    assert cli.main(["layout", str(tmp_path / "g.json"), "-o", str(tmp_path / "p.csv"), "--hide-unresolved", "--relationships", "contains"]) == 0
    assert len((tmp_path / "p.csv").read_text().splitlines()) == 29
    capsys.readouterr()
    assert cli.main(["layout", str(tmp_path / "g.json"), "-o", str(tmp_path / "p.svg"), "--hide-derived", "--title", "A title", "--show"]) == 0
    assert "A title" in (tmp_path / "p.svg").read_text() and capsys.readouterr().out.startswith("<svg")


def test_contexts_and_experiments(spark):
    ranking = spark.createDataFrame([(1, "a", 1, 0.5, "x" * 10), (1, "b", 2, 0.4, "y" * 10)], "query_id long, entity_id string, rank int, score double, text string")
    asked = spark.createDataFrame([(1, "why?"), (2, "what?")], "query_id long, text string")
    prompts = {r.query_id: r.prompt for r in retrieve.build_context(ranking, asked, 15).collect()}
    assert prompts == {1: "Context:\nxxxxxxxxxx\n\nQuestion: why?", 2: "Context:\n\n\nQuestion: what?"}

    class Good:
        def retrieve(self, questions, k, repository=None):
            return ranking

    class Bad:
        def retrieve(self, questions, k, repository=None):
            raise RuntimeError("no model")

    rows = retrieve.run_experiment({"good": Good(), "bad": Bad()}, asked).collect()
    assert sorted((r.method, r.entity_id or "", r.error or "") for r in rows) == [("bad", "", "no model"), ("good", "a", ""), ("good", "b", "")]


def test_retrievers_answer_alike(spark, graph, analysis):
    index = embed(chunk_graph(graph, analysis.contents), HashingEmbedder(64))
    asked = spark.createDataFrame([(1, "what does coat call on the Glaze class"), (2, "Kiln Door open")], "query_id long, text string")
    named = retrieve.StructuralRetriever(graph, index, max_hops=1)
    semantic = retrieve.SemanticRetriever(index, HashingEmbedder(64))
    methods = [retrieve.BM25Retriever(index), semantic, named, retrieve.HybridRetriever(semantic, named), retrieve.GraphAwareRetriever(graph, semantic, index)]
    chunks = {r.entity_id: r for r in index.collect()}
    for method in methods:
        rows = method.retrieve(asked, 5, "repository").collect()
        assert method.retrieve(asked, 5, "another").count() == 0 and {r.query_id for r in rows} == {1, 2}
        for r in rows:
            assert tuple(r.asDict()) == retrieve.RESULT and r.retrieval_method == method.name and 1 <= r.rank <= 5
            assert (r.file_path, r.source_code) == (chunks[r.entity_id].file_path, chunks[r.entity_id].source_code)
            assert json.loads(r.provenance)["method"] == method.name
    top = {r.query_id: r for r in retrieve.BM25Retriever(index).retrieve(asked, 1).collect()}
    assert top[2].entity_id in ("class:kiln/fire.py:Kiln.Door", "method:kiln/fire.py:Kiln.Door.open")
    near = named.retrieve(asked, 9).where("query_id = 1").collect()
    assert {json.loads(r.provenance)["seed"] for r in near} <= {"func:kiln/glaze.py:coat", "class:kiln/glaze.py:Glaze"}


class Letters:
    """A stand-in for a model: a token's vector counts its letters a and b; texts are padded to the longest."""

    dimension = 2
    made = 0

    def __init__(self):
        Letters.made += 1

    def __call__(self, texts, longest):
        words = [t.split()[:longest] for t in texts]
        most = max(map(len, words), default=0)
        pad = lambda w: w + ["ab" * 50] * (most - len(w))
        return [[[float(t.count("a")), float(t.count("b"))] for t in pad(w)] for w in words], [[1] * len(w) + [0] * (most - len(w)) for w in words]


def test_pooling_by_mask():
    from sparkweft.operators.chunk import PooledEmbedder

    embedder = PooledEmbedder(Letters, 2, longest=3, batch=2)
    got = embedder(["a b", "aa", "", "b b b aaaa", None])
    want = [(0.5**0.5, 0.5**0.5), (1.0, 0.0), (0.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    assert [tuple(round(x, 6) for x in v) for v in got] == [tuple(round(x, 6) for x in w) for w in want]
    made = Letters.made
    assert embedder([]) == [] and embedder(["a"]) == [[1.0, 0.0]] and Letters.made == made  # one model a worker


def test_every_word_of_a_long_text_is_embedded():
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)]
    one, other = HashingEmbedder(64)([" ".join(words), " ".join([*words, "harvest", "orchard"])])
    assert one != other and abs(sum(x * x for x in other) - 1) < 1e-9
