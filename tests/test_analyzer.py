import json

import pytest
from sparkweft.operators import build
from sparkweft.sources.analyzer import analyze_repository
from sparkweft.sources.ast_facts import facts
from tests import samples


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    root = samples.write(tmp_path_factory.mktemp("tree") / "pottery")
    return analyze_repository(spark, str(root))


def relations(analysis, kind):
    return {(r.source, r.target) for r in analysis.relationships.where(f"type = '{kind}'").collect()}


def test_golden_counts(sample):
    """Counted by hand: 27 things are contained, 9 imports, 2 bases, 17 calls of which 8 resolve, 4 pairs of files."""
    assert sample.stats() == {"total_entities": 28, "total_relationships": 59, "primitive_relationships": 55, "derived_relationships": 4, "unresolved_calls_count": 11}
    by_type = {r.type: r["count"] for r in sample.entities.groupBy("type").count().collect()}
    assert by_type == {"Repository": 1, "Directory": 3, "File": 7, "Class": 4, "Function": 8, "Method": 5}


def test_golden_relations(sample):
    timer, start = "kiln/tools/timer.py", "func:setup_kiln.py:start"
    assert relations(sample, "CALLS") == {
        ("file:setup_kiln.py", "unresolved:max"), (start, f"class:{timer}:Timer"), (start, f"func:{timer}:wait"), (start, "func:kiln/glaze.py:coat"),
        ("method:kiln/fire.py:Kiln.Door.open", "unresolved:self.swing"), ("method:kiln/fire.py:Kiln.__init__", "class:kiln/fire.py:Kiln.Door"), ("method:kiln/fire.py:Kiln.heat", "unresolved:round"),
        ("func:kiln/fire.py:light.spark", "class:kiln/fire.py:Kiln"), ("func:kiln/fire.py:light", "unresolved:kiln.glaze.coat"), ("func:kiln/fire.py:light", "func:kiln/fire.py:light.spark"),
        ("func:kiln/glaze.py:coat", "class:kiln/glaze.py:Glaze"), (f"func:{timer}:timed.outer.inner", "unresolved:wraps"), (f"func:{timer}:timed.outer.inner", "unresolved:f"),
        (f"func:{timer}:wait", f"func:{timer}:timed"), (f"func:{timer}:wait", "unresolved:aio.sleep"), (f"file:{timer}", "unresolved:len"), (f"method:{timer}:Timer.__init__", "unresolved:sorted"),
    }
    assert relations(sample, "INHERITS") == {("class:kiln/glaze.py:Glaze", "external:fire.Kiln"), ("class:kiln/glaze.py:Glaze", "external:dict")}
    assert relations(sample, "IMPORTS") == {
        ("file:setup_kiln.py", "file:kiln/glaze.py"), ("file:setup_kiln.py", f"file:{timer}"), ("file:kiln/__init__.py", "module:.fire"), ("file:kiln/fire.py", "module:asyncio"),
        ("file:kiln/fire.py", "file:kiln/glaze.py"), ("file:kiln/glaze.py", "file:kiln/__init__.py"), (f"file:{timer}", "module:asyncio"), (f"file:{timer}", "module:functools"),
    }
    assert relations(sample, "DEPENDS_ON") == {("file:setup_kiln.py", "file:kiln/glaze.py"), ("file:setup_kiln.py", f"file:{timer}"), ("file:kiln/fire.py", "file:kiln/glaze.py"), ("file:kiln/glaze.py", "file:kiln/__init__.py")}
    row = sample.relationships.where("type = 'DEPENDS_ON' AND source = 'file:setup_kiln.py' AND target = 'file:kiln/glaze.py'").first()
    assert json.loads(row.properties) == {"derived": True, "reasons": ["CALLS", "IMPORTS"], "weight": 2}
    row = sample.relationships.where("id = 'rel:calls:func:setup_kiln.py:start->func:kiln/glaze.py:coat:11:12'").first()
    assert json.loads(row.properties) == {"raw_call": "glazing.coat", "resolved": True, "confidence": "symbol_table_match"}
    held = {t: s for s, t in relations(sample, "CONTAINS")}
    assert held["class:kiln/fire.py:Kiln.Door"] == "file:kiln/fire.py" and held["method:kiln/fire.py:Kiln.Door.open"] == "class:kiln/fire.py:Kiln.Door"
    assert held["func:kiln/fire.py:light.spark"] == "func:kiln/fire.py:light" and held["dir:kiln/tools"] == "dir:kiln" and held["dir:docs"] == "repo:pottery"


def test_document_builds_a_graph_and_hash_repeats(spark, sample):
    graph = build.build_from_analysis(spark, json.loads(sample.to_json()), on_missing="placeholder")
    assert (graph.number_of_nodes(), graph.number_of_edges()) == (42, 59)
    assert sample.canonical_hash(portable=True) == analyze_repository(spark, sample.metadata["root_path"]).canonical_hash(portable=True)


def test_equal_identifiers_keep_their_order(spark, tmp_path):
    root = samples.write(tmp_path / "r", {"a.py": "from m import z, b, k\ndef f(x): pass\ndef f(y): pass\n"})
    rows = analyze_repository(spark, str(root)).to_dict()
    assert [r["properties"]["imported_symbol"] for r in rows["relationships"] if r["type"] == "IMPORTS"] == ["z", "b", "k"]
    assert [e["properties"]["parameters"] for e in rows["entities"] if e["type"] == "Function"] == [["x"], ["y"]] and set(rows["entities"][0]) == {"id", "type", "name", "path", "location", "properties"}


def test_scopes():
    text = "import os, a.b as c\nfrom . import x\nfrom m import *\nclass A(B.C):\n    @d\n    async def f(self, p, *, q):\n        def g():\n            h()\n        class I:\n            def j(self): pass\n    class K: pass\n    def l(self): pass\n"
    rows = facts("p.py", text)
    functions = {r["qualified_name"]: (r["is_method"], r["parent"], r["is_async"], r["parameters"]) for r in rows if r["kind"] == "function"}
    assert functions == {"A.f": (True, "A", True, ["self", "p"]), "A.f.g": (False, "A.f", False, []), "A.f.I.j": (False, "A.f.I", False, ["self"]), "A.l": (True, "A", False, ["self"])}
    assert [(r["module"], r.get("symbol"), r["alias"], r["is_wildcard"]) for r in rows if r["kind"] == "import"] == [("os", None, None, False), ("a.b", None, "c", False), (".", "x", None, False), ("m", None, None, True)]
    assert [(r["name"], r["owner"]) for r in rows if r["kind"] == "call"] == [("h", "func:p.py:A.f.g")]
    assert facts("bad.py", "def (:") == [] and facts("bad.py", b"\xff\xfe") == []


def test_scenarios(spark, tmp_path):
    root = samples.write(tmp_path, {
        "gate.py": "def admit(): pass\n", "house.py": "from gate import admit\nimport os\n\ndef enter():\n    admit()\n    os.path.join('a')\n",
        "nested.py": "def day():\n    def tick(): pass\n    tick()\ndef night():\n    def tick(): pass\n", ".venv/x.py": "a = 1\n", "empty/readme.txt": "x", "bad.py": "def (",
    })
    found = analyze_repository(spark, str(root))
    ids = {r.id for r in found.entities.collect()}
    assert {"func:nested.py:day.tick", "func:nested.py:night.tick", "dir:empty", "file:bad.py"} <= ids and "file:.venv/x.py" not in ids
    assert ("func:house.py:enter", "func:gate.py:admit") in relations(found, "CALLS")
    assert ("func:house.py:enter", "unresolved:os.path.join") in relations(found, "CALLS")
    assert relations(found, "IMPORTS") == {("file:house.py", "file:gate.py"), ("file:house.py", "module:os")}
    assert relations(analyze_repository(spark, str(root), include_derived=False), "DEPENDS_ON") == set()
    with pytest.raises(FileNotFoundError):
        analyze_repository(spark, str(root / "none"))
