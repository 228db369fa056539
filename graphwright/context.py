"""Context planning: candidate pools of a plan and the seeds that each strategy takes from them.

Pools are answers of bounded searches, so they are lists on the driver; what they are chosen from
and what is around the seeds stays distributed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.functions import text as T
from graphwright.operators import search

#: Nodes of a search by path, by name or directory, by term and by fallback text; seeds.
BY_PATH, BY_NAME, BY_TERM, BY_TEXT = 80, 40, 12, 20
SEEDS, PER_FILE = 12, 2
PATH_KEYS = ("file_path", "owner_path", "display_path", "readable_path", "reference_path")
SCOPES = {"relationship": "relationship_summary", "source-oriented": "source_window"}


def make_plan(spark: SparkSession, query: str) -> dict:
    return spark.range(1).select(T.plan(F.lit(query)).alias("p")).first()["p"].asDict()


def _stem(path: str) -> str:
    return re.sub(r"(?i)\.(?:tres|res|tscn|gd)$", "", path.rsplit("/", 1)[-1])


def _named(node: dict, name: str) -> bool:
    return node["name"] in (name, f"{name}.tres") or node["qualified_name"].endswith(f"/{name}.tres") or _stem(node["file_path"] or node["name"]) == name or f"/{name}." in node["id"]


def _resource(node: dict, _: str = "") -> bool:
    return node["kind"] == "resource"


def searches(plan: dict) -> dict[str, tuple[list[tuple[str, int]], Callable[[dict, str], bool]]]:
    """Each pool's (term, limit) searches, in order, and the test its nodes must pass."""
    recall = plan["texts"] if plan["fallback"] else []
    by = lambda terms, limit: [(t, limit) for t in terms]
    words = plan["fields"] + plan["symbols"]
    swapped = plan["symbols"] + plan["fields"]
    anyone = lambda node, term: True
    return {
        "exact_path": (by(plan["paths"], BY_PATH), lambda n, t: any(n.get(k) == t for k in PATH_KEYS)),
        "exact_resource_name": (by(plan["resource_names"], BY_NAME), lambda n, t: _resource(n) and _named(n, t)),
        "resource_path": (by(plan["directories"] + plan["paths"], BY_NAME), _resource),
        "resource_metadata": (by(words + recall, BY_TERM) if plan["strategy"] == "resource-first" else [], _resource),
        "symbol_exact": (by(swapped, BY_TERM), lambda n, t: t in (n["name"], n["qualified_name"], n["id"], n["file_path"])),
        "symbol_text": (by(swapped + recall, BY_TERM), lambda n, t: not _resource(n)),
        "relationship": (by(swapped + recall, BY_TERM) if plan["strategy"] == "relationship" else [], anyone),
        "fallback": (by([plan["query"], *plan["texts"]], BY_TEXT) if plan["fallback"] else [], anyone),
    }


def _once(nodes: Iterable[dict]) -> list[dict]:
    return list({n["id"]: n for n in reversed(list(nodes))}.values())[::-1]


def pools(nodes: DataFrame, plan: dict) -> dict[str, list[dict]]:
    """All pools, by one run of all their searches."""
    wanted = searches(plan)
    found = search.run(nodes, [s for terms, _ in wanted.values() for s in terms])
    return {name: _once(n for term, limit in terms for n in found.get((term.strip(), limit), []) if keep(n, term)) for name, (terms, keep) in wanted.items()}


def symbol_priority(node: dict) -> int:
    """Tests last, then what looks like interface or topic text."""
    if re.search(r"(?i)(^|/)tests?/", node["file_path"] or ""):
        return 30
    said = " ".join((node["name"], node["qualified_name"], node["file_path"] or ""))
    return 20 if re.search(r"(?i)\b(panel|topic|ui|text)\b", said) else 0


def source_priority(query: str, node: dict) -> int:
    low = query.lower()
    held = [p.lower() for p in (node.get(k) for k in ("readable_path", "file_path", "display_path", "owner_path")) if p]
    told = [p for p in held if p in low]
    if told:
        return 0 if any(p.endswith(".gd") for p in told) else 10
    return 30 if _resource(node) else 20


#: Pools of each strategy in the order they are taken; a star marks those sorted by symbol_priority.
ORDERS = {
    "resource-named": ("anchored", "symbol_exact", "*symbol_text", "*fallback"),
    "resource-directory": ("exact_path", "resource_path", "resource_metadata", "symbol_exact", "*symbol_text", "*fallback"),
    "resource-first": ("exact_path", "exact_resource_name", "resource_metadata", "resource_path", "symbol_exact", "*symbol_text", "*fallback"),
    "symbol-exact": ("symbol_exact", "resource_metadata"),
    "symbol-first": ("symbol_text", "resource_metadata", "fallback"),
    "relationship": ("relationship", "symbol_exact", "symbol_text", "fallback"),
    "source-oriented": ("symbol_exact", "symbol_text", "fallback", "exact_path", "exact_resource_name", "resource_path", "resource_metadata"),
    "general": ("symbol_exact", "resource_path", "resource_metadata", "symbol_text", "fallback"),
}


def _few_per_file(nodes: list[dict]) -> list[dict]:
    seen: dict[str, int] = {}
    out = []
    for n in nodes:
        if _resource(n):
            key = n["file_path"] or n["qualified_name"]
            seen[key] = seen.get(key, 0) + 1
            if seen[key] > PER_FILE:
                continue
        out.append(n)
    return out


def anchor_files(plan: dict, pools: dict[str, list[dict]]) -> list[str]:
    """Files that a resource-first query names; neighbours from other resource files are noise."""
    named = pools["exact_resource_name"] if plan["strategy"] == "resource-first" else []
    return list(dict.fromkeys(n["file_path"] for n in named if n["file_path"]))


def select(plan: dict, pools: dict[str, list[dict]], evidence: Callable[[list[str]], dict[str, int]]) -> list[dict]:
    """At most SEEDS nodes. evidence counts the relationships of ids; only the relationship strategy asks."""
    kind, held = plan["strategy"], dict(pools)
    if kind == "resource-first":
        if plan["paths"] and pools["exact_path"]:
            return _few_per_file(pools["exact_path"])[:SEEDS]
        files = {n["file_path"] for n in pools["exact_resource_name"] if n["file_path"]}
        held["anchored"] = [n for p in ("exact_resource_name", "resource_metadata", "resource_path") for n in pools[p] if _resource(n) and n["file_path"] in files]
        order = "resource-named" if pools["exact_resource_name"] else "resource-directory" if plan["directories"] else kind
    else:
        order = "symbol-exact" if kind == "symbol-first" and pools["symbol_exact"] else kind
    taken = _once(n for p in ORDERS[order] for n in (sorted(held[p[1:]], key=lambda n: (symbol_priority(n), n["id"])) if p[0] == "*" else held[p]))
    if kind == "resource-first":
        taken = _few_per_file(taken)
    elif kind == "relationship":
        n_of = evidence([n["id"] for n in taken])
        taken.sort(key=lambda n: (-n_of.get(n["id"], 0), n["id"]))
    elif kind == "source-oriented":
        taken.sort(key=lambda n: (source_priority(plan["query"], n), n["id"]))
    return taken[:SEEDS]


def evidence(edges: DataFrame, refs: DataFrame, ids: list[str]) -> dict[str, int]:
    """Edges that touch each id, a self loop once, and open references from it."""
    if not ids:
        return {}
    ends = F.filter(F.array_distinct(F.array("source", "target")), lambda x: x.isin(*ids))
    n = edges.where(F.col("source").isin(*ids) | F.col("target").isin(*ids)).select(F.explode(ends).alias("id")).unionAll(refs.where(F.col("from_id").isin(*ids) & ~F.col("resolved")).select("from_id"))
    return {r["id"]: r["count"] for r in n.groupBy("id").count().collect()}
