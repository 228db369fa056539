"""What a verb gives back: a bounded view in which paths and nodes are named once and referred to.

Everything here works on the few dozen rows that a view holds.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

#: Most nodes, relationships, snippets and characters of a context; of a snippet's lines.
NODES, RELATIONS, SNIPPETS, CHARS, LINES, FILES = 40, 40, 6, 4800, 20, 6
#: The shortest directory that is worth a name.
PREFIX = len("res://a/b/")
SYMBOLS = ("script_class", "inner_class", "method", "property", "signal", "autoload")


class InvariantError(RuntimeError):
    """A view that refers to something it does not hold."""


@dataclass
class View:
    query: str
    strategy: str
    scope: str
    entries: list[str]
    nodes: list[dict]
    relations: list[dict]
    between: list[dict] = field(default_factory=list)
    snippets: list[dict] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    blast: dict | None = None
    chars: int = CHARS
    omitted: dict = field(default_factory=lambda: {"nodes": 0, "relationships": 0, "snippets": 0})
    left_out: dict = field(default_factory=dict)


def chars(value: object) -> int:
    """Length as JSON in UTF-16 units."""
    return len(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode("utf-16-le")) // 2


def endpoints(relations: Iterable[dict]) -> list[str]:
    return [e for r in relations for e in ((r["source"],) if r["provenance"] == "unresolved" else (r["source"], r["target"]))]


def category(node: dict) -> str:
    paths = " ".join(p for p in (node.get(k) for k in ("file_path", "display_path", "owner_path", "readable_path")) if p)
    if re.search(r"(?i)(^|/)tests?/", paths):
        return "test"
    return "resource" if node["kind"] == "resource" else "scene" if node["kind"] in ("scene", "scene_node") else "script" if node["kind"] in SYMBOLS else "other"


class Paths:
    """p1, p2, .. for paths in order of first use, with their common directory as @p1."""

    def __init__(self, paths: Iterable[str | None]):
        held = list(dict.fromkeys(p for p in paths if p))
        shared = os.path.commonprefix([p[: p.rfind("/") + 1] for p in held])
        shared = shared[: shared.rfind("/") + 1]
        self.prefixes = {"@p1": shared} if len(held) > 1 and len(shared) >= PREFIX else {}
        self.ref = {p: f"p{k}" for k, p in enumerate(held, 1)}
        self.paths = {r: "@p1/" + p[len(shared) :] if self.prefixes else p for p, r in self.ref.items()}


def whole_path(view: dict, ref: str) -> str | None:
    path = view["paths"].get(ref)
    for name, value in view.get("prefixes", {}).items():
        if path and path.startswith(name + "/"):
            return value + path[len(name) + 1 :]
    return path


def shown(node: dict) -> str | None:
    return node.get("display_path") or node.get("readable_path") or node.get("owner_path") or node.get("reference_path") or node.get("file_path")


def _node(node: dict, paths: Paths, refs: dict[str, str]) -> dict:
    out = {"id": refs[node["id"]], "kind": node["kind"], "name": node["name"]}
    if node["qualified_name"] != node["name"] and not node["qualified_name"].startswith("res://"):
        out["qname"] = node["qualified_name"]
    for key, value in (("path", paths.ref.get(shown(node) or "")), ("line", node.get("start_line")), ("signature", node.get("signature"))):
        if value is not None:
            out[key] = value
    return out


def _relation(r: dict, paths: Paths, refs: dict[str, str]) -> dict:
    out = {"from": refs[r["source"]], "kind": r["kind"], "provenance": r["provenance"]}
    if r["provenance"] != "unresolved":
        out["to"] = refs[r["target"]]
    elif r["target"] in paths.ref:
        out["targetPath"] = paths.ref[r["target"]]
    else:
        out["target"] = r["target"]
    return out


def finish(view: View) -> dict:
    """The view with names for paths and nodes, and its own length."""
    every = [*view.relations, *view.between]
    far = [r["target"] for r in every if r["provenance"] == "unresolved" and r["target"].startswith("res://")]
    paths = Paths([*(shown(n) for n in view.nodes), *(s["path"] for s in view.snippets), *far, *(view.blast or {}).get("checkFiles", [])])
    ids = dict.fromkeys([*(n["id"] for n in view.nodes), *endpoints(every), *view.entries])
    refs = {i: f"n{k}" for k, i in enumerate(ids, 1)}
    on_view = {n["id"] for n in view.nodes}
    selectors = {refs[n["id"]]: {"id": n["id"], "kind": n["kind"]} for n in view.nodes if n["kind"] in ("scene_node", "autoload", "input_action", "project") or not shown(n)}
    selectors |= {refs[i]: {"id": i} for i in ids if i not in on_view}
    truncated, empty = any(view.omitted.values()), not (view.nodes or every or view.snippets)
    out = {"query": view.query, "strategy": view.strategy, "completeness": {"scope": view.scope, "complete": False}, "resultHint": "no_indexed_matches" if empty and not truncated else "navigation_sample_not_exhaustive"}
    if paths.prefixes:
        out["prefixes"] = paths.prefixes
    out |= {"paths": paths.paths, "entryPoints": [refs[i] for i in view.entries], "pathsBetween": [_relation(r, paths, refs) for r in view.between]}
    if view.blast:
        out["blastRadius"] = {"entryPoints": [refs[i] for i in view.blast["entryPoints"] if i in refs], "checkFiles": [paths.ref[p] for p in view.blast["checkFiles"]], "relationshipCount": view.blast["relationshipCount"]}
    out |= {"nodes": [_node(n, paths, refs) for n in view.nodes], "relationships": [_relation(r, paths, refs) for r in view.relations]}
    out |= {"snippets": [{"path": paths.ref[s["path"]], "start": s["start"], "end": s["end"], "text": s["text"]} for s in view.snippets], "truncated": truncated, "omitted": dict(view.omitted)}
    if view.left_out:
        out["omittedSummary"] = {"nodes": dict(view.left_out)}
    if selectors:
        out["selectors"] = selectors
    out["budget"] = {"maxChars": view.chars, "estimatedChars": 0}
    for _ in range(3):  # the number is part of what it measures
        if (n := chars(out)) == out["budget"]["estimatedChars"]:
            break
        out["budget"]["estimatedChars"] = n
    check(out)
    return out


def check(view: dict) -> None:
    """Every reference is known and every path is used."""
    known = {n["id"] for n in view["nodes"]} | set(view.get("selectors", {}))
    for r in [*view["relationships"], *view["pathsBetween"]]:
        if r["from"] not in known:
            raise InvariantError("unresolved_relationship_source")
        if r.get("to", r["from"]) not in known:
            raise InvariantError("unresolved_relationship_target")
    used = {n.get("path") for n in view["nodes"]} | {s["path"] for s in view["snippets"]} | {r.get("targetPath") for r in [*view["relationships"], *view["pathsBetween"]]} | set(view.get("blastRadius", {}).get("checkFiles", []))
    if set(view["paths"]) - used:
        raise InvariantError("orphan_context_path")


def _leave_out(view: View, at: int) -> None:
    kind = category(view.nodes.pop(at))
    view.left_out[kind] = view.left_out.get(kind, 0) + 1
    view.omitted["nodes"] += 1


def _last(rows: list[dict], protected: set[str], which) -> int | None:
    return next((k for k in range(len(rows) - 1, -1, -1) if not which(rows[k], protected)), None)


def fit(view: View) -> dict:
    """Cut to the counts, then to the characters: snippets, relationships and nodes away from the entry
    points first, then the rest of the relationships, then nodes."""
    entries = set(view.entries)
    near = entries | set(endpoints([*view.relations, *view.between]))
    while len(view.nodes) > NODES:
        at = _last(view.nodes, near, lambda n, keep: n["id"] in keep)
        _leave_out(view, len(view.nodes) - 1 if at is None else at)
    for rows, most, name in ((view.relations, RELATIONS, "relationships"), (view.snippets, SNIPPETS, "snippets")):
        view.omitted[name] += max(0, len(rows) - most)
        del rows[most:]
    while (out := finish(view))["budget"]["estimatedChars"] > view.chars:
        if view.snippets:
            view.snippets.pop()
            view.omitted["snippets"] += 1
        elif (at := _last(view.relations, entries, lambda r, keep: any(e in keep for e in endpoints([r])))) is not None:
            del view.relations[at]
            view.omitted["relationships"] += 1
        elif (at := _last(view.nodes, near, lambda n, keep: n["id"] in keep)) is not None:
            _leave_out(view, at)
        elif view.relations:
            view.relations.pop()
            view.omitted["relationships"] += 1
        elif view.nodes:
            _leave_out(view, len(view.nodes) - 1)
        else:
            break
    return out


def next_steps(view: dict) -> list[dict]:
    """At most two nodes worth reading next, from different files, and the standing verbs."""
    steps: dict[str, dict] = {}
    for n in view["nodes"]:
        file = whole_path(view, n["path"]) if "path" in n else None
        if file and file not in steps and len(steps) < 2:
            if n["kind"] in ("resource", "scene", "file"):
                steps[file] = {"verb": "node", "args": {"file": file}}
            elif n["kind"] in SYMBOLS:
                steps[file] = {"verb": "node", "args": {"file": file, "symbol": n["name"]}}
    return [*(steps.values() or [{"verb": "node"}]), {"verb": "status"}, {"verb": "sync"}]


def finish_node(target: dict, symbols: list[dict], notes: dict[str, dict], source: dict | None, stale: list[str]) -> dict:
    """A node read: notes name nodes that are already shown by reference only."""
    noted = [n for g in notes.values() for n in g["items"]]
    paths = Paths([*(shown(n) for n in [target, *symbols, *noted]), *([source["path"]] if source else []), *stale])
    refs = {i: f"n{k}" for k, i in enumerate(dict.fromkeys(n["id"] for n in [target, *symbols, *noted]), 1)}
    seen = {target["id"], *(n["id"] for n in symbols)}

    def one(n: dict) -> dict:
        first = n["id"] not in seen
        seen.add(n["id"])
        return ({**_node(n, paths, refs), "selector": n["id"]} if first else {"id": refs[n["id"]]}) | ({"via": n["via"]} if "via" in n else {})

    out = {"ok": True, "paths": paths.paths, "target": {**_node(target, paths, refs), "selector": target["id"]}}
    if paths.prefixes:
        out["prefixes"] = paths.prefixes
    if symbols:
        out["symbols"] = [_node(n, paths, refs) for n in symbols]
    if notes:
        out["notes"] = {name: {"items": [one(n) for n in g["items"]], "omitted": g["omitted"]} for name, g in notes.items()}
        if any(g["omitted"] for g in notes.values()):
            out["resultHint"] = "navigation_sample_not_exhaustive"
    if source:
        out["source"] = {**source, "path": paths.ref[source["path"]]}
    if stale:
        out |= {"stale": True, "staleFiles": [paths.ref[p] for p in stale]}
    return out
