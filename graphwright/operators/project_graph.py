"""Facts to a typed graph, and name resolution that never guesses: a name that more than one target
answers to leaves its reference open. Everything here is joins over fact rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.operators.receivers import Receivers
from graphwright.operators.relational import asof_last, coalesce_joins, first_wins, unique_or_null

#: Engine classes whose use as a base is no reference.
ENGINE_BASES = (
    """
    AcceptDialog Area2D Area3D AudioStreamPlayer AudioStreamPlayer2D AudioStreamPlayer3D Button Camera2D Camera3D CanvasItem CanvasLayer CharacterBody2D CharacterBody3D
    CheckBox CodeEdit CollisionObject2D CollisionObject3D ColorRect Control EditorPlugin FileDialog GridContainer HBoxContainer HTTPRequest HSlider HScrollBar ItemList
    Label Line2D MarginContainer MeshInstance3D NinePatchRect Node Node2D Node3D Object OptionButton Panel PanelContainer Popup PopupPanel ProgressBar Range RefCounted
    Resource RichTextLabel RigidBody2D RigidBody3D SceneTree ScrollContainer StaticBody2D StaticBody3D SubViewport SubViewportContainer TabContainer TextEdit TextureButton
    TextureRect Timer Tree VBoxContainer VSlider VScrollBar Window
    """.split()
)


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    refs: DataFrame


def script_nodes(facts: DataFrame) -> DataFrame:
    """Script classes, inner classes and members; duplicates of (kind, owner, name) get @line."""
    base = F.regexp_replace(F.substring_index("path", "/", -1), r"\.gd$", "")
    scripts = facts.where(F.endswith("path", F.lit(".gd"))).groupBy("path").agg(F.max_by(F.when(F.col("fact") == "class_name", F.col("name")), F.when(F.col("fact") == "class_name", F.col("line"))).alias("named"))
    scripts = scripts.withColumn("script", F.coalesce("named", base))
    heads = scripts.select(F.concat(F.lit("script:"), "path").alias("id"), F.lit("script_class").alias("kind"), F.col("script").alias("name"), F.col("script").alias("qualified_name"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"), F.lit(None).cast("string").alias("owner"), F.lit(False).alias("static"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("signature"))
    members = facts.where(F.col("fact").isin("method", "property", "signal", "inner_class")).join(scripts.select("path", "script"), "path")
    many = members.groupBy("path", "fact", "owner", "name").agg(F.count("*").alias("k"))
    same = (members["path"] == many["path"]) & (members["fact"] == many["fact"]) & (members["name"] == many["name"]) & members["owner"].eqNullSafe(many["owner"])
    members = members.join(many.where("k > 1"), same, "left_semi").withColumn("at", F.concat(F.lit("@"), F.col("line").cast("string"))).unionByName(members.join(many.where("k > 1"), same, "left_anti").withColumn("at", F.lit("")))
    local = F.concat(F.coalesce(F.concat("owner", F.lit(".")), F.lit("")), "name", "at")
    rows = members.select(
        F.concat("fact", F.lit(":"), "path", F.lit(":"), local).alias("id"), F.col("fact").alias("kind"), "name", F.concat("script", F.lit("."), local).alias("qualified_name"), F.col("path").alias("file_path"), F.col("line").alias("start_line"),
        "owner", (F.col("attrs")["static"] == "True").alias("static"), F.coalesce(F.col("target"), F.col("attrs")["returns"]).alias("type"), F.col("attrs")["signature"].alias("signature"),
    )
    return heads.unionByName(rows)


def other_nodes(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Project, autoloads, actions, scenes, scene nodes, resources and sub-resources."""
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, kind: str, ident: Column, name: Column, qualified: Column) -> DataFrame:
        return df.select(ident.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), qualified.alias("qualified_name"), F.col("path").alias("file_path"), F.coalesce(F.col("line"), F.lit(1)).alias("start_line"), none.alias("owner"), F.lit(False).alias("static"), none.alias("type"), none.alias("signature"))

    files = files.withColumn("line", F.lit(1))
    title = facts.where("fact = 'project_name'").select(F.col("path").alias("t_path"), F.col("name").alias("title"))
    projects = files.where("kind = 'project'").join(title, F.col("path") == F.col("t_path"), "left")
    title = F.coalesce("title", F.lit("Godot Project"))
    base, parent = F.substring_index("path", "/", -1), F.col("attrs")["parent"]
    at = F.when(parent.isNull() | (parent == "."), F.col("name")).otherwise(F.concat(parent, F.lit("/"), "name"))
    return (
        rows(projects, "project", F.lit("project"), title, title)
        .unionByName(rows(facts.where("fact = 'autoload'"), "autoload", F.concat(F.lit("autoload:"), "name"), F.col("name"), F.col("name")))
        .unionByName(rows(facts.where("fact = 'input_action'"), "input_action", F.concat(F.lit("input_action:"), "name"), F.col("name"), F.col("name")))
        .unionByName(rows(files.where("kind = 'scene'"), "scene", F.concat(F.lit("scene:"), "path"), base, F.col("path")))
        .unionByName(rows(files.where("kind = 'resource'"), "resource", F.concat(F.lit("resource:"), "path"), base, F.col("path")))
        .unionByName(rows(facts.where("fact = 'node'"), "scene_node", F.concat(F.lit("scene_node:"), "path", F.lit(":"), at), F.col("name"), F.concat("path", F.lit(":"), at)))
        .unionByName(rows(facts.where("fact = 'sub_resource'"), "resource", F.concat(F.lit("resource:"), "path", F.lit("#"), "name"), F.col("name"), F.concat("path", F.lit("#"), "name")))
    )


def references(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_id, kind, name, receiver, target, path, line, ord): what files refer to. The owner of a
    script reference is the method whose start is the last at or before its line, if it is inside."""
    kinds = {"call": "calls", "emit": "emits_signal", "connect": "connects_signal", "action": "uses_input_action", "autoload_use": "uses_autoload", "extends": "extends", "symbol": "references_symbol", "node_path": "references_nodepath", "main_scene": "main_scene", "connection": "editor_signal_connection"}
    mapped = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    rows = facts.where(F.col("fact").isin(*kinds, "resource", "autoload") & ~((F.col("fact") == "extends") & F.col("name").isin(*ENGINE_BASES)))
    kind = F.when(F.col("fact") == "resource", F.concat("receiver", F.lit("s_resource"))).when(F.col("fact") == "autoload", "autoload_resource").otherwise(mapped[F.col("fact")])
    rows = rows.select("path", "ord", "line", "method", F.col("fact"), kind.alias("kind"), F.when(F.col("fact") == "autoload", F.col("target")).otherwise(F.col("name")).alias("name"), F.when(F.col("fact") != "resource", F.col("receiver")).alias("receiver"), "target", F.col("name").alias("own"), F.col("attrs")["from"].alias("origin"))
    methods = nodes.where("kind = 'method'").select(F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.lit(-1).alias("ord"), F.col("id").alias("m_id"))
    both = asof_last(rows.withColumn("m_id", F.lit(None).cast("string")).unionByName(methods, allowMissingColumns=True), ["path"], ["line", "ord"], F.col("m_id"), "scope").where("ord >= 0")
    tops = facts.where("fact = 'node' and coalesce(attrs['parent'], '.') = '.'").groupBy(F.col("path").alias("t_path")).agg(F.min_by("name", "ord").alias("top"))
    both = both.join(tops, (F.col("path") == F.col("t_path")) & (F.col("kind") == "editor_signal_connection"), "left")
    origin = F.when(F.coalesce("origin", F.lit("")).isin("", "."), F.col("top")).otherwise(F.col("origin"))
    scene = F.concat(F.lit("scene_node:"), "path", F.lit(":"), origin)
    owner = F.when(F.col("kind") == "main_scene", "project").when(F.col("kind") == "autoload_resource", F.concat(F.lit("autoload:"), "own")).when(F.col("kind") == "editor_signal_connection", scene).when(F.col("method").isNotNull(), F.col("scope")).otherwise(F.concat(F.lit("script:"), "path"))
    return both.select(owner.alias("from_id"), "kind", "name", "receiver", "target", "path", "line", "ord")


def parser_edges(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, kind, provenance): containment, attached scripts, instances, resources."""
    head = nodes.where("kind = 'script_class'").select("file_path", F.col("id").alias("script_id"))
    inner = nodes.where("kind = 'inner_class'").select("file_path", F.col("name").alias("owner"), F.col("id").alias("class_id"))
    members = nodes.where(F.col("kind").isin("method", "property", "signal", "inner_class")).join(head, "file_path").join(inner, ["file_path", "owner"], "left")
    contains = members.select(F.coalesce("class_id", "script_id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), F.lit("script-parser").alias("provenance"))
    own = nodes.where("kind in ('autoload', 'input_action')").select(F.lit("project").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), F.lit("resource-parser").alias("provenance"))
    scene = nodes.where("kind = 'scene_node'").select(F.concat(F.lit("scene:"), "file_path"), "id", F.lit("contains"), F.lit("resource-parser"))
    ext = facts.where("fact = 'ext_resource'").select("path", F.col("name").alias("ref"), F.col("target").alias("res"))
    loads = ext.select(F.when(F.endswith("path", F.lit(".tscn")), F.concat(F.lit("scene:"), "path")).otherwise(F.concat(F.lit("resource:"), "path")), F.concat(F.lit("resource:"), "res"), F.lit("loads_resource"), F.lit("resource-parser"))
    parent, name = F.col("attrs")["parent"], F.col("name")
    node_id = F.concat(F.lit("scene_node:"), "path", F.lit(":"), F.when(parent.isNull() | (parent == "."), name).otherwise(F.concat(parent, F.lit("/"), name)))
    uses = facts.where("fact = 'node'").select("path", node_id.alias("source"), "name", F.regexp_extract(F.col("attrs")["instance"], r'ExtResource\("([^"]+)"\)', 1).alias("ref"), "line")
    made = uses.join(ext, ["path", "ref"]).select("source", F.concat(F.lit("resource:"), "res"), F.lit("instantiates_scene"), F.lit("resource-parser"))
    starts = uses.select("path", "line", F.lit(-1).alias("ord"), F.col("source").alias("holder"))
    given = facts.where("fact = 'assign' and name = 'script' and receiver = 'ExtResource'")
    assigns = given.where("method = 'node'").select("path", "line", "ord", F.col("target").alias("ref"))
    held = asof_last(assigns.withColumn("holder", F.lit(None).cast("string")).unionByName(starts, allowMissingColumns=True), ["path"], ["line", "ord"], F.col("holder"), "source").where("ord >= 0")
    scripts = held.join(ext, ["path", "ref"]).select("source", F.concat(F.lit("resource:"), "res"), F.lit("attaches_script"), F.lit("resource-parser"))
    main = F.concat(F.lit("resource:"), "path")
    bodies = given.where("method <> 'node' and endswith(path, '.tres')").withColumn("ref", F.col("target")).join(ext, ["path", "ref"])
    bodies = bodies.select(F.when(F.col("method") == "resource", main).otherwise(F.concat(main, F.lit("#"), "owner")), F.concat(F.lit("resource:"), "res"), F.lit("attaches_script"), F.lit("resource-parser"))
    subs = facts.where("fact = 'sub_resource' and endswith(path, '.tres')").select(main, F.concat(main, F.lit("#"), "name"), F.lit("contains"), F.lit("resource-parser"))
    return contains.unionAll(own).unionAll(scene).unionAll(loads).unionAll(made).unionAll(scripts).unionAll(bodies).unionAll(subs).distinct()


def addresses(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """nodes with the address tuple of their role. paths: (path) of the project's files; a resource
    node without a file of its own is an external reference if its path is one, else missing."""
    known = paths.select(F.concat(F.lit("resource:"), "path").alias("id"), F.col("path").alias("x_path"))
    nodes = nodes.join(known, "id", "left").withColumn("external", (F.col("kind") == "resource") & F.col("file_path").isNull())
    missing = F.col("external") & F.col("x_path").isNull()
    role = (
        F.when(missing, "resource_missing_ref").when(F.col("external"), "resource_external_ref").when((F.col("kind") == "resource") & F.contains("id", F.lit("#")), "resource_subresource").when(F.col("kind") == "resource", "resource_main")
        .when(F.col("kind").isin("project", "autoload", "input_action"), "project_virtual").when(F.col("kind") == "scene", "indexed_file").otherwise("indexed_symbol")
    )
    nodes = nodes.withColumn("address_kind", role).withColumn("file_path", F.when(F.col("external"), F.col("x_path")).otherwise(F.col("file_path")))
    shown, kind = F.when(missing, F.col("qualified_name")).otherwise(F.col("file_path")), F.col("address_kind")
    nodes = nodes.withColumn("owner_path", F.when(kind != "resource_missing_ref", F.col("file_path"))).withColumn("readable_path", F.when(~kind.isin("resource_missing_ref", "resource_subresource"), F.col("file_path")))
    return nodes.withColumn("display_path", shown).withColumn("reference_path", F.when(kind.isin("resource_external_ref", "resource_missing_ref"), shown)).drop("external", "x_path")


def recount(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """files with node_count: the distinct nodes that name the file, also from other files."""
    counts = nodes.where("file_path is not null").groupBy(F.col("file_path").alias("path")).agg(F.countDistinct("id").alias("node_count"))
    return files.drop("node_count").join(counts, "path", "left").withColumn("node_count", F.coalesce("node_count", F.lit(0)))


def resolve(refs: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, hold: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> tuple[DataFrame, DataFrame]:
    """(resolver edges, refs with resolved). Lookups are unique-or-null; own file before global; a
    receiver is an autoload, else a class, else whatever its type says."""
    ref = refs.withColumn("rid", F.concat_ws("|", "path", "ord"))
    scopes = ref.where("receiver is not null and receiver <> 'self'").select("rid", "path", "line", "receiver", F.when(F.startswith("from_id", F.lit("method:")), F.col("from_id")).alias("scope"))
    types = hold(Receivers(facts, nodes, hold).types(scopes), "receiver_types")
    named = lambda kind: nodes.where(F.col("kind") == kind)
    by_name = lambda df, out: unique_or_null(df, ["name"], "id", out)
    local = lambda df, out: unique_or_null(df.select(F.col("file_path").alias("path"), "name", "id"), ["path", "name"], "id", out)
    found = []

    def take(df: DataFrame, kind: str) -> None:
        found.append(df.where("to is not null").select("rid", F.col("from_id").alias("source"), F.col("to").alias("target"), F.lit(kind).alias("kind")))

    paths = nodes.where("kind in ('scene', 'script_class', 'resource') and not contains(id, '#')").select(F.col("file_path").alias("name"), "id", "kind")
    lookup = lambda kind, out: paths.where(F.col("kind") == kind).groupBy("name").agg(F.min("id").alias(out))
    for kind, order, made in (("main_scene", ("scene",), "main_scene"), ("autoload_resource", ("script_class", "scene"), "loads_resource"), ("preloads_resource", ("resource", "scene", "script_class"), "preloads_resource"), ("loads_resource", ("resource", "scene", "script_class"), "loads_resource")):
        take(coalesce_joins(ref.where(F.col("kind") == kind), [(lookup(k, f"t{n}"), ["name"], f"t{n}") for n, k in enumerate(order)], "to", None), made)
    for kind, target in (("uses_input_action", "input_action"), ("uses_autoload", "autoload")):
        take(ref.where(F.col("kind") == kind).join(by_name(named(target), "to"), "name"), kind)
    method, signal, scripts = named("method"), named("signal"), named("script_class")
    editor = ref.where("kind = 'editor_signal_connection'").drop("name").withColumn("name", F.col("target"))
    take(editor.join(by_name(method, "to"), "name"), "connects_signal")
    connects = ref.where("kind = 'connects_signal'")
    take(connects.where("receiver is null or receiver = 'self'").join(local(signal, "to"), ["path", "name"]), "connects_signal")
    autos = ref.where("kind = 'autoload_resource'").select(F.expr("substring(from_id, 10)").alias("receiver"), F.col("name").alias("auto_path"))
    classes = by_name(scripts, "class_id").withColumnRenamed("name", "receiver").join(scripts.select(F.col("id").alias("class_id"), F.col("file_path").alias("class_path")), "class_id").drop("class_id")
    held = connects.where("receiver is not null").join(autos, "receiver", "left").join(classes, "receiver", "left").withColumn("path", F.coalesce("auto_path", "class_path"))
    take(held.join(local(signal, "to"), ["path", "name"]), "connects_signal")
    handlers = connects.drop("name").withColumn("name", F.col("target")).withColumn("rid", F.concat("rid", F.lit("|h")))
    take(coalesce_joins(handlers, [(local(method, "t0"), ["path", "name"], "t0"), (by_name(method, "t1"), ["name"], "t1")], "to", None), "connects_signal")
    first = signal.groupBy(F.col("file_path").alias("path"), "name").agg(F.min("id").alias("t0"))
    take(coalesce_joins(ref.where("kind = 'emits_signal'"), [(first, ["path", "name"], "t0"), (by_name(signal, "t1"), ["name"], "t1")], "to", None), "emits_signal")
    calls = ref.where("kind = 'calls'")
    take(coalesce_joins(calls.where("receiver is null"), [(local(method, "t0"), ["path", "name"], "t0"), (by_name(method, "t1"), ["name"], "t1")], "to", None), "calls")
    typed_by = types.join(classes.withColumnsRenamed({"receiver": "type", "class_path": "typed_path"}), "type").drop("type")
    far = calls.where("receiver is not null").join(autos, "receiver", "left").join(classes, "receiver", "left").join(typed_by, "rid", "left")
    member = lambda static, path, out: unique_or_null(method.where("static" if static else "not static").withColumnRenamed("file_path", path), [path, "name"], "id", out)
    take(coalesce_joins(far, [(member(False, "auto_path", "t0"), ["auto_path", "name"], "t0"), (member(True, "class_path", "t1"), ["class_path", "name"], "t1"), (member(False, "typed_path", "t2"), ["typed_path", "name"], "t2")], "to", None), "calls")
    symbols, ref_symbols = nodes.where("kind in ('property', 'signal', 'method', 'inner_class')"), ref.where("kind = 'references_symbol'")
    wider = symbols.unionByName(scripts)
    take(coalesce_joins(ref_symbols.where("receiver is null"), [(local(symbols, "t0"), ["path", "name"], "t0"), (by_name(wider, "t1"), ["name"], "t1")], "to", None), "references_symbol")
    take(ref_symbols.where("receiver = 'self'").join(local(symbols, "to"), ["path", "name"]), "references_symbol")
    of = ref_symbols.where("receiver <> 'self'").join(types, "rid", "left").withColumn("receiver", F.coalesce("type", "receiver")).join(classes, "receiver")
    take(of.join(unique_or_null(symbols.withColumnRenamed("file_path", "class_path"), ["class_path", "name"], "id", "to"), ["class_path", "name"]), "references_symbol")
    by_path = scripts.select(F.col("file_path").alias("name"), F.col("id").alias("t0"))
    take(coalesce_joins(ref.where("kind = 'extends'"), [(by_path, ["name"], "t0"), (by_name(scripts, "t1"), ["name"], "t1")], "to", None), "extends")
    promoted = edges.where("kind in ('attaches_script', 'instantiates_scene')").withColumn("name", F.expr("substring(target, 10)"))
    promoted = promoted.join(lookup("script_class", "s"), "name", "left").join(lookup("scene", "c"), "name", "left").withColumn("to", F.when(F.col("kind") == "attaches_script", F.col("s")).otherwise(F.col("c")))
    promoted = promoted.where("to is not null").select("source", F.col("to").alias("target"), "kind")
    paths_to = ref.where("kind = 'references_nodepath'")
    rooted = paths_to.where("target = 'root'").withColumn("name", F.regexp_extract("name", "^(?:/root/)?([^/]+)", 1))
    take(rooted.join(by_name(named("autoload"), "to"), "name"), "uses_autoload")
    places = named("scene_node").select(F.col("id").alias("place"))
    attached = promoted.where("kind = 'attaches_script'").join(named("scene_node").select(F.col("id").alias("source"), "file_path"), "source")
    attached = unique_or_null(attached.select("target", "source"), ["target"], "source", "source").join(named("scene_node").select(F.col("id").alias("source"), F.col("file_path").alias("scene_path")), "source")
    behind = types.join(by_name(scripts, "class_id").withColumnRenamed("name", "type"), "type").join(attached.select(F.col("target").alias("class_id"), "scene_path"), "class_id").select("rid", "scene_path")
    inside = lambda path: F.concat(F.lit("scene_node:"), path, F.lit(":"), "name")
    spots = paths_to.join(behind, "rid", "left").withColumn("p0", inside(F.col("scene_path"))).withColumn("p1", F.when(F.endswith("path", F.lit(".gd")), inside(F.regexp_replace("path", r"\.gd$", ".tscn"))))
    spots = spots.join(places.select(F.col("place").alias("p0"), F.col("place").alias("t0")), "p0", "left").join(places.select(F.col("place").alias("p1"), F.col("place").alias("t1")), "p1", "left")
    take(spots.withColumn("to", F.coalesce("t0", "t1")).withColumn("rid", F.concat("rid", F.lit("|n"))), "references_nodepath")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    out = out.where("source is not null").join(nodes.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    done = out.select(F.regexp_replace("rid", r"\|[hn]$", "").alias("rid")).distinct().withColumn("hit", F.lit(True))
    typed = out.select("source", "target", "kind").unionAll(promoted)
    refs = ref.join(done, "rid", "left").withColumn("resolved", F.coalesce("hit", F.lit(False))).drop("hit", "rid")
    return typed.distinct().withColumn("provenance", F.lit("resolver")), refs


def build(files: DataFrame, facts: DataFrame, hold: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> Graph:
    """The graph of a file table. Autoload uses of names that are not declared are dropped, unless
    there is no manifest. Edges to files outside the project keep a missing-resource node. hold may
    write a step and read it back: the resolver's many branches then share it."""
    known = script_nodes(facts).unionByName(other_nodes(files, facts))
    nodes = first_wins(known, ["id"], ["file_path", "start_line"])
    nodes = hold(nodes, "known_nodes")
    edges = hold(parser_edges(facts, nodes), "parser_edges")
    missing = edges.where(F.startswith("target", F.lit("resource:"))).select(F.col("target").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    path = F.expr("substring(id, 10)")
    nodes = nodes.unionByName(missing.select("id", F.lit("resource").alias("kind"), F.substring_index(path, "/", -1).alias("name"), path.alias("qualified_name")), allowMissingColumns=True)
    nodes = hold(addresses(nodes, files.select("path")), "nodes")
    refs = references(facts, nodes)
    declared = facts.where("fact = 'autoload'").select("name").distinct()
    if not files.where("kind = 'project'").isEmpty():
        refs = refs.where("kind <> 'uses_autoload'").unionByName(refs.where("kind = 'uses_autoload'").join(declared, "name", "left_semi"))
        rooted = (F.col("kind") == "references_nodepath") & F.coalesce(F.col("target") == "root", F.lit(False))
        named = refs.where(rooted).withColumn("auto", F.regexp_extract("name", "^(?:/root/)?([^/]+)", 1)).join(declared.withColumnRenamed("name", "auto"), "auto", "left_anti").drop("auto")
        refs = refs.where(~rooted).unionByName(named)
    resolved, refs = resolve(hold(refs, "open_refs"), nodes, edges, facts, hold)
    return Graph(nodes, edges.unionByName(resolved), refs)
