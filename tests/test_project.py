"""Parsers, graph, resolver, sync and verbs on a small project of our own."""

import pytest

from graphwright.api import Project
from graphwright.sources import parsers, project_files
from graphwright.streaming import watch

FILES = {
    "project.godot": '; a game\n[application]\nconfig/name="Lantern"\nrun/main_scene="res://main.tscn"\n[autoload]\nHub="*res://hub.gd"\n[input]\njump={\n"deadzone": 0.5\n}\nbroken line\n',
    "main.tscn": '[gd_scene load_steps=3 format=3]\n[ext_resource type="Script" path="res://lamp.gd" id="1"]\n[ext_resource type="PackedScene" path="res://post.tscn" id="2"]\n[node name="Main" type="Node2D"]\nscript = ExtResource("1")\n[node name="Post" parent="." instance=ExtResource("2")]\n[connection signal="pressed" from="Post" to="." method="on_lit"]\n',
    "post.tscn": '[gd_scene format=3]\n[node name="Post" type="Node2D"]\ndata = {\n"a": 1\n}\n',
    "lamp.gd": 'extends Node2D\nclass_name Lamp\nsignal lit(level)\nconst Oil = preload("res://oil.tres")\n@export var level: int = 3\nfunc _ready():\n\tlit.connect(on_lit)\n\tHub.report("x") # Hub.ignored()\n\tif Input.is_action_pressed("jump"):\n\t\tburn(level)\n\tvar s = "burn(1)"\nfunc burn(amount: int) -> int:\n\temit_signal("lit", amount)\n\tTools.twice(amount)\n\treturn amount\nfunc on_lit(level):\n\tget_node("/root/Hub").x()\n\tget_node("/root/Nobody")\n\tsame()\n',
    "hub.gd": "extends Node\nfunc report(what):\n\tpass\nfunc same():\n\tpass\n",
    "tools.gd": "class_name Tools\nstatic func twice(x):\n\treturn x * 2\nfunc same():\n\tpass\nclass Inner:\n\tvar deep = 1\n\tfunc same():\n\t\tpass\n",
    "oil.tres": '[gd_resource type="Resource" format=3]\n[sub_resource type="Curve" id="c"]\n[resource]\ncurve = SubResource("c")\n',
    "addons/skip.gd": "class_name Skipped\n",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("game")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    p = Project(spark, str(root), f"file://{tmp_path_factory.mktemp('store')}/g")
    assert p.status()["initialized"] is False
    p.first = p.sync()
    return p


def edges(p, kind):
    return {(r["source"], r["target"]) for r in p.table("edges").where(f"kind = '{kind}' and provenance = 'resolver'").collect()}


def test_sync_and_status(project):
    assert project.first["added"] == 7 and project.first["parseErrorCount"] == 1
    s = project.status()
    assert s["ok"] and s["indexFresh"] and s["files"] == 7


def test_nodes(project):
    ids = {r["id"] for r in project.table("nodes").collect()}
    assert {"project", "autoload:Hub", "input_action:jump", "script:res://lamp.gd", "method:res://lamp.gd:burn", "signal:res://lamp.gd:lit", "property:res://lamp.gd:level", "scene:res://main.tscn", "scene_node:res://main.tscn:Post", "resource:res://oil.tres", "resource:res://oil.tres#c", "inner_class:res://tools.gd:Inner", "method:res://tools.gd:Inner.same"} <= ids
    assert not any("skip" in i for i in ids)


def test_resolution(project):
    assert edges(project, "main_scene") == {("project", "scene:res://main.tscn")}
    assert ("method:res://lamp.gd:_ready", "method:res://lamp.gd:burn") in edges(project, "calls")
    assert ("method:res://lamp.gd:_ready", "method:res://hub.gd:report") in edges(project, "calls")
    assert ("method:res://lamp.gd:burn", "method:res://tools.gd:twice") in edges(project, "calls")
    assert not any(t.endswith(":same") or ":Inner.same" in t for _, t in edges(project, "calls"))  # ambiguous
    assert ("method:res://lamp.gd:burn", "signal:res://lamp.gd:lit") in edges(project, "emits_signal")
    assert edges(project, "connects_signal") == {("method:res://lamp.gd:_ready", "signal:res://lamp.gd:lit"), ("method:res://lamp.gd:_ready", "method:res://lamp.gd:on_lit"), ("scene_node:res://main.tscn:Post", "method:res://lamp.gd:on_lit")}
    assert ("method:res://lamp.gd:_ready", "input_action:jump") in edges(project, "uses_input_action")
    assert edges(project, "attaches_script") == {("scene_node:res://main.tscn:Main", "script:res://lamp.gd")}
    assert edges(project, "instantiates_scene") == {("scene_node:res://main.tscn:Post", "scene:res://post.tscn")}
    assert edges(project, "preloads_resource") == {("script:res://lamp.gd", "resource:res://oil.tres")}
    assert all(t == "autoload:Hub" for _, t in edges(project, "uses_autoload"))
    ends = project.table("edges").select("source").union(project.table("edges").select("target")).distinct()
    assert ends.join(project.table("nodes").selectExpr("id as source"), "source", "left_anti").count() == 0


def test_context_and_node(project):
    view = project.context("Lamp burn")
    by_ref = {n["id"]: n for n in view["nodes"]}
    assert view["strategy"] == "symbol-first" and [by_ref[e]["qname" if "qname" in by_ref[e] else "name"] for e in view["entryPoints"]][0] == "Lamp"
    assert view["indexFresh"] and view["budget"]["estimatedChars"] <= 4800
    whole = {(r["from"], r["kind"], r.get("to")) for r in view["relationships"]}
    assert all(a in by_ref or a in view.get("selectors", {}) for a, _, _ in whole)
    assert any(n["name"] == "burn" for n in view["nodes"]) and view["snippets"][0]["text"].startswith("extends Node2D")
    assert view["next"][0]["verb"] == "node"
    assert project.context("zz_yy_xx")["resultHint"] == "no_indexed_matches"
    named = project.context("rename res://oil.tres metadata")
    assert named["strategy"] == "resource-first" and named["blastRadius"]["checkFiles"] and "oil.tres" in [n["name"] for n in named["nodes"]]
    callers = project.context("callers of burn")
    assert callers["strategy"] == "relationship" and callers["completeness"]["scope"] == "relationship_summary"
    node = project.node(symbol="burn")
    assert node["target"]["selector"] == "method:res://lamp.gd:burn" and node["notes"]["callers"]["items"][0]["selector"] == "method:res://lamp.gd:_ready"
    assert node["source"]["lines"][0].startswith("12\tfunc burn")
    inside = project.node(file="res://tools.gd", symbols_only=True)
    assert inside["target"]["kind"] == "script_class" and {n["name"] for n in inside["symbols"]} >= {"twice", "Inner"} and "source" not in inside
    with pytest.raises(ValueError):
        project.node()
    assert project.node(id="none") == {"ok": False, "error": "not_found"}


def test_small_budgets_and_invariants():
    from graphwright import output

    node = lambda k, kind="method": {"id": f"{kind}:res://dir/sub/f{k}.gd:x{k}", "kind": kind, "name": f"x{k}", "qualified_name": f"F.x{k}", "file_path": f"res://dir/sub/f{k}.gd", "start_line": k, "signature": None}
    nodes = [node(k) for k in range(60)]
    relations = [{"source": nodes[0]["id"], "kind": "calls", "target": nodes[k]["id"], "provenance": "resolver"} for k in range(1, 10)] + [{"source": nodes[0]["id"], "kind": "calls", "target": "gone", "provenance": "unresolved"}]
    make = lambda chars: output.View("q", "general", "bounded_navigation", [nodes[0]["id"]], list(nodes), list(relations), snippets=[{"path": nodes[0]["file_path"], "start": 1, "end": 2, "text": "a" * 500}], chars=chars)
    for chars in (400, 1200, 3000, 100_000):
        view = output.fit(make(chars))
        assert view["budget"]["estimatedChars"] <= chars or not view["nodes"]
        assert output.chars(view) == view["budget"]["estimatedChars"]
        assert len(view["nodes"]) + view["omitted"]["nodes"] == 60 and len(view["nodes"]) <= 40
        assert sum(view.get("omittedSummary", {"nodes": {}})["nodes"].values()) == view["omitted"]["nodes"]
    assert view["prefixes"] == {"@p1": "res://dir/sub/"} and output.whole_path(view, "p2") == "res://dir/sub/f1.gd" and len(view["relationships"]) == 10
    with pytest.raises(output.InvariantError):
        output.check({"nodes": [], "relationships": [{"from": "n1", "to": "n2"}], "pathsBetween": [], "snippets": [], "paths": {}})
    with pytest.raises(output.InvariantError):
        output.check({"nodes": [], "relationships": [], "pathsBetween": [], "snippets": [], "paths": {"p1": "res://a"}})


def test_lock_and_quiet_sync(project):
    from graphwright.store import Busy, Store

    version = project.state.current()
    assert project.sync()["added"] == 0 and project.state.current() == version and {"index", "sync"} <= set(project.state.metadata())
    with project.state.writing():
        assert project.sync()["retryAfterMs"] == 1000
    other = Store(project.spark, project.store + "/lock")
    other._write("LOCK", '{"pid": 1, "host": "elsewhere"}')
    with pytest.raises(Busy), other.writing():
        pass
    other._write("LOCK", f'{{"pid": 99999999, "host": "{__import__("socket").gethostname()}"}}')
    with other.writing():
        pass
    project.mark("res://lamp.gd")
    assert project.status()["staleFiles"] == ["res://lamp.gd"]
    project.pending.clear()


TYPED = {
    "project.godot": '[application]\nconfig/name="Typed"\n[autoload]\nHub="*res://hub.gd"\nBoth="*res://both.gd"\n',
    "hub.gd": "extends Node\nsignal lit\nfunc report():\n\tpass\n",
    "both.gd": "class_name Both\nextends Node\nstatic func make():\n\tpass\nfunc use():\n\tpass\n",
    "item.gd": "class_name Item\nextends Resource\nvar owner_lamp: Lamp\nvar weight: int = 1\nfunc burn():\n\tpass\n",
    "lamp.gd": "class_name Lamp\nextends Node2D\nvar items: Array[Item] = []\nvar by_name: Dictionary[String, Item] = {}\nvar best: Item\nfunc glow():\n\tpass\nfunc burn():\n\tpass\n",
    "lamp.tscn": '[gd_scene load_steps=2 format=3]\n[ext_resource type="Script" path="res://lamp.gd" id="1"]\n[node name="Lamp" type="Node2D"]\nscript = ExtResource("1")\n[node name="Leaf" parent="."]\n',
    "user.gd": """extends Node
const Thing = preload("res://item.gd")
signal pressed_twice
func by_parameter(lamp: Lamp, other):
	lamp.glow()
	lamp.best.burn()
	lamp.best.owner_lamp.glow()
	other.glow()
func by_locals(
	first: Lamp,
	n: int,
):
	var a: Item = null
	a.burn()
	var b := Thing.new()
	b.burn()
	var c = get_thing() as Lamp
	c.burn()
	var d = helper()
	d.glow()
	var e = first.best
	var f = e
	f.burn()
	for item in first.items:
		item.burn()
	first.get_node("Leaf")
	print(first.items.size(), sin(1.0), Vector2(1, 2))
	Hub.lit.connect(done)
	Both.use()
	pressed.emit()
	pressed_twice.emit()
func helper() -> Lamp:
	return null
func done():
	pass
""",
}


def test_typed_receivers(spark, tmp_path):
    for name, text in TYPED.items():
        (tmp_path / "game" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "game" / name).write_text(text)
    p = Project(spark, str(tmp_path / "game"), f"file://{tmp_path}/store/g")
    p.sync()
    m = "method:res://user.gd:"
    glow, lamp_burn, item_burn = "method:res://lamp.gd:glow", "method:res://lamp.gd:burn", "method:res://item.gd:burn"
    assert edges(p, "calls") == {(m + "by_parameter", glow), (m + "by_parameter", item_burn), (m + "by_locals", item_burn), (m + "by_locals", lamp_burn), (m + "by_locals", glow), (m + "by_locals", m + "helper"), (m + "by_locals", "method:res://both.gd:use")}
    assert (m + "by_locals", "signal:res://hub.gd:lit") in edges(p, "connects_signal") and (m + "by_locals", m + "done") in edges(p, "connects_signal")
    assert edges(p, "references_nodepath") == {(m + "by_locals", "scene_node:res://lamp.tscn:Leaf")}
    assert (m + "by_parameter", "property:res://lamp.gd:best") in edges(p, "references_symbol")
    assert edges(p, "emits_signal") == {(m + "by_locals", "signal:res://user.gd:pressed_twice")}
    open_refs = {(r["kind"], r["receiver"], r["name"]) for r in p.table("refs").where("not resolved").collect()}
    assert ("calls", "other", "glow") in open_refs and not any(k == "extends" for k, _, _ in open_refs)
    assert not any(n in ("sin", "print", "size", "Vector2", "pressed") for _, _, n in open_refs)
    roles = {r["id"]: (r["address_kind"], r["file_path"]) for r in p.table("nodes").where("kind = 'resource'").collect()}
    assert roles == {"resource:res://lamp.gd": ("resource_external_ref", "res://lamp.gd")}
    assert {r["path"]: r["node_count"] for r in p.table("files").collect()}["res://lamp.gd"] == 7


def test_incremental_sync_equals_rebuild(spark, project, tmp_path):
    import pathlib

    root = pathlib.Path(project.root)
    (root / "hub.gd").write_text("extends Node\nfunc report(what):\n\thelp()\nfunc help():\n\tpass\n")
    (root / "new.gd").write_text("class_name Fresh\n")
    (root / "oil.tres").unlink()
    assert set(project.stale()) == {"res://hub.gd", "res://new.gd", "res://oil.tres"}
    done = project.sync()
    assert (done["added"], done["modified"], done["deleted"]) == (1, 1, 1)
    whole = Project(spark, project.root, f"file://{tmp_path}/g")
    whole.sync()
    for name in ("nodes", "edges", "refs"):
        a, b = project.table(name), whole.table(name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert project.sync()["modified"] == 0


def test_parsers_alone():
    facts = parsers.parse_script('func a(\n\tx: int,\n):\n\tfoo("(", b(1), c)\n\tself.d.e()\n\t$Path/To.go()\nvar z = Callable(self, "m")\n')
    assert [(f[0], f[4]) for f in facts if f[0] == "call"] == [("call", "foo"), ("call", "b"), ("call", "e"), ("call", "go")]
    assert parsers.arguments('"a,b", f(x, y), z) tail') == ['"a,b"', "f(x, y)", "z"]
    assert [f[0] for f in parsers.parse_resource("x = 1\n")] == ["error"]
    assert parsers.strip_comment('a = "#" # no') == 'a = "#" '
    long = parsers.parse_script("func f():\n" + "\tg()\n" * 20_000)
    assert sum(f[0] == "call" for f in long) == 20_000


def test_not_a_project(spark, tmp_path):
    (tmp_path / "a.gd").write_text("pass\n")
    with pytest.raises(project_files.NotAProject):
        Project(spark, str(tmp_path), f"file://{tmp_path}/s").sync()
    with pytest.raises(project_files.NotADirectory):
        Project(spark, str(tmp_path / "a.gd"), f"file://{tmp_path}/s").sync()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"root": "r", "path": "a.gd", "ts": "2024-01-01T00:00:00Z"}\n{"root": "r", "path": ".git/x", "ts": "2024-01-01T00:00:01Z"}\n{"root": "r", "path": "a.gd.uid", "ts": "2024-01-01T00:00:01Z"}\n')
    seen = []
    q = watch.run(watch.change_stream(spark, str(tmp_path / "in")), lambda df, n: seen.extend(r["path"] for r in watch.pending(df).collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert seen == ["a.gd"]
    rows = spark.read.schema("root string, path string, ts timestamp").json(str(tmp_path / "in"))
    assert [r["changes"] for r in watch.debounced(watch.watched(rows)).collect()] == [1]


def test_long_resource_paths_stay_whole(spark, tmp_path):
    far = "/".join(["deep" * 20] * 8)
    assert len(far) > 600
    files = {
        "project.godot": '[application]\nconfig/name="Far"\n',
        "main.tscn": f'[gd_scene format=3]\n[ext_resource type="Script" path="res://{far}/lamp.gd" id="1"]\n[ext_resource type="PackedScene" path="res://{far}/post.tscn" id="2"]\n[ext_resource type="Texture2D" path="res://{far}/none.png" id="3"]\n[node name="Main" type="Node2D"]\nscript = ExtResource("1")\n[node name="Post" parent="." instance=ExtResource("2")]\n',
        f"{far}/lamp.gd": "extends Node2D\n",
        f"{far}/post.tscn": '[gd_scene format=3]\n[node name="Post" type="Node2D"]\n',
    }
    for name, text in files.items():
        (tmp_path / "game" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "game" / name).write_text(text)
    p = Project(spark, str(tmp_path / "game"), f"file://{tmp_path}/store/g")
    p.sync()
    assert edges(p, "attaches_script") == {("scene_node:res://main.tscn:Main", f"script:res://{far}/lamp.gd")}
    assert edges(p, "instantiates_scene") == {("scene_node:res://main.tscn:Post", f"scene:res://{far}/post.tscn")}
    gone = p.table("nodes").where("kind = 'resource' and endswith(id, 'none.png')").collect()
    assert [(r["name"], r["qualified_name"]) for r in gone] == [("none.png", f"res://{far}/none.png")]
