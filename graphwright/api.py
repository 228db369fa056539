"""The verbs: sync, status, context, node and clean over a project folder.

State is a folder of Parquet tables in any file system that Spark reaches; a sync writes a new
version beside the old one and then swaps a pointer, so readers never see half a graph, and one
version back stays for those that still read it. Facts are owned by the file that states them, so an
incremental sync equals a rebuild.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright import context as C
from graphwright import output as O
from graphwright.functions import text as T
from graphwright.operators import graph as G
from graphwright.operators import neighbourhood as N
from graphwright.operators import project_graph as P
from graphwright.operators import search
from graphwright.sources import parsers, project_files
from graphwright.store import RETRY_MS, Busy, Store

TABLES = ("files", "facts", "nodes", "edges", "refs")
SEEDS = C.SEEDS


class Project:
    def __init__(self, spark: SparkSession, root: str, store: str):
        self.spark, self.root, self.store = spark, root, store.rstrip("/")
        self.state = Store(spark, store)
        self.pending: set[str] = set()

    def table(self, name: str) -> DataFrame:
        return self.state.table(name)

    def sync(self, rebuild: bool = False) -> dict:
        """Parses new and changed files only, rebuilds the graph from all facts, swaps versions. Writes
        nothing but the time if no file has changed."""
        try:
            with self.state.writing():
                done = self._sync(rebuild)
        except Busy as e:
            return {"ok": False, "error": "sync_in_progress", "message": str(e), "retryAfterMs": RETRY_MS}
        self.pending.clear()
        return done

    def _sync(self, rebuild: bool) -> dict:
        current = project_files.scan(self.spark, self.root)
        project_files.require_project(current)
        version = f"v-{uuid.uuid4().hex}"
        at = f"{self.store}/{version}"
        old = None if rebuild else self.state.current()
        changes = {"added": 0, "modified": 0, "deleted": 0}
        if old is not None:
            diff = project_files.diff(self.table("files"), current)
            changes |= {r["change"]: r["count"] for r in diff.where("change <> 'unchanged'").groupBy("change").count().collect()}
            if not any(changes.values()):
                self.state.note(sync=changes)
                return {"ok": True, **changes, **self._errors()}
        current.write.parquet(f"{at}/scanned")
        files = self.spark.read.parquet(f"{at}/scanned")
        if old is None:
            changes["added"] = files.count()
            facts = parsers.facts(files)
        else:
            same = project_files.diff(self.table("files"), files).where("change = 'unchanged'").select("path")
            facts = self.table("facts").join(same, "path", "left_semi").unionByName(parsers.facts(files.join(same, "path", "left_anti")))
        facts.write.parquet(f"{at}/facts")

        def hold(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{at}/{name}")
            return self.spark.read.parquet(f"{at}/{name}")

        graph = P.build(files, self.spark.read.parquet(f"{at}/facts"), hold)
        for name in ("edges", "refs"):
            hold(getattr(graph, name), name)
        hold(P.recount(files, graph.nodes), "files")
        fs, where = self.state._at(version)
        for entry in fs.listStatus(where):
            if entry.getPath().getName() not in TABLES:
                fs.delete(entry.getPath(), True)
        self.state.publish(version)
        self.state.note(index={"version": version, "full": old is None}, sync=changes)
        return {"ok": True, **changes, **self._errors()}

    def _errors(self) -> dict:
        errors = self.table("facts").where("fact = 'error'")
        said = [f"{r['path']}: " + (r["name"] if r["line"] is None else f"line {r['line']}: {r['name']}") for r in errors.orderBy("path", "ord").limit(10).collect()]
        return {"parseErrors": said, "parseErrorCount": errors.count()}

    def status(self) -> dict:
        if self.state.current() is None:
            return {"ok": False, "initialized": False, "indexEmpty": True, "indexFresh": False}
        counts = {name: self.table(name).count() for name in ("files", "nodes", "edges")}
        counts["unresolved"] = self.table("refs").where("not resolved").count()
        stale, noted = self.stale(), self.state.metadata()
        when = next((noted[k]["updated_at"] for k in ("sync", "index") if k in noted), None)
        return {"ok": counts["nodes"] > 0, "initialized": True, "indexEmpty": counts["nodes"] == 0, **counts, "indexFresh": not stale, "staleFiles": stale, "lastSyncedAt": when}

    def mark(self, *paths: str) -> None:
        """Remembers changed paths that no sync has seen."""
        self.pending.update(paths)

    def stale(self) -> list[str]:
        """Changed files by content, and those marked as pending."""
        diff = project_files.diff(self.table("files"), project_files.scan(self.spark, self.root))
        return sorted({r["path"] for r in diff.where("change <> 'unchanged'").collect()} | self.pending)

    def _freshness(self, paths: set[str]) -> dict:
        """Stale files that the output names; the rest is counted."""
        stale = self.stale()
        if not stale:
            return {"indexFresh": True}
        named = [p for p in stale if p in paths]
        return {"indexFresh": False, "staleFiles": named, "staleFilesOmitted": len(stale) - len(named)}

    def edges(self, **conditions: str) -> DataFrame:
        """Edges by any of source, target, kind and provenance, in order."""
        return self._where("edges", conditions, ("source", "kind", "target"))

    def refs(self, resolved: bool = False, **conditions: str) -> DataFrame:
        """Open references by any of their columns; with resolved, all."""
        rows = self._where("refs", conditions, ("path", "ord"))
        return rows if resolved else rows.where("not resolved")

    def _where(self, name: str, conditions: dict, order: tuple[str, ...]) -> DataFrame:
        rows = self.table(name)
        for column, value in conditions.items():
            rows = rows.where(F.col(column) == value)
        return rows.orderBy(*order)

    def context(self, query: str, max_files: int = O.FILES, include_code: bool = True) -> dict:
        """Seeds of the query's strategy, their neighbourhood and first lines, within the budget."""
        nodes, edges, refs = (self.table(name) for name in ("nodes", "edges", "refs"))
        plan = C.make_plan(self.spark, query)
        pools = C.pools(nodes, plan)
        chosen = C.select(plan, pools, lambda ids: C.evidence(edges, refs, ids))
        view = O.View(query, plan["strategy"], C.SCOPES.get(plan["strategy"], "bounded_navigation"), [], [], [])
        if chosen:
            seeds = self.spark.createDataFrame([(k, n["id"], n["name"], n["qualified_name"]) for k, n in enumerate(chosen)], "at int, id string, name string, qualified_name string")
            around = N.hop(seeds, nodes, edges, refs, C.anchor_files(plan, pools)).cache()
            try:
                view.relations = [r.asDict() for r in N.relationships(around).collect()]
                view.nodes = [r.asDict() for r in N.related(seeds, around, nodes).collect()]
                count = around.count()
            finally:
                around.unpersist()
            view.entries = [n["id"] for n in chosen if n["id"] in {m["id"] for m in view.nodes}]
            if len(chosen) > 1:
                view.between = [r.asDict() for r in N.paths_between(seeds, nodes, edges).collect()]
            view.files = list(dict.fromkeys(n["file_path"] for n in view.nodes if n["file_path"]))[: max(1, max_files)]
            if re.search(T.EDIT, query):
                view.blast = {"entryPoints": list(view.entries), "checkFiles": view.files, "relationshipCount": count}
            view.snippets = self._snippets(view.files) if include_code else []
        out = O.fit(view)
        whole = {O.whole_path(out, p) for p in out["paths"]}
        return out | self._freshness({p for p in whole if p}) | {"next": O.next_steps(out)}

    def _snippets(self, paths: list[str]) -> list[dict]:
        """The first lines of each file."""
        rows = project_files.lines(self.table("files").where(F.col("path").isin(*paths))).where(F.col("line") <= O.LINES)
        held = rows.groupBy("path").agg(F.max("line").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
        found = {r["path"]: r for r in held.collect()}
        return [{"path": p, "start": 1, "end": found[p]["end"], "text": found[p]["text"]} for p in paths if p in found]

    def _targets(self, nodes: DataFrame, id: str | None, file: str | None, symbol: str | None) -> list[dict]:  # noqa: A002
        """Nodes that a selector means, best first: by file, its own head and then its symbols."""
        if id is not None:
            return [r.asDict() for r in nodes.where(F.col("id") == id).collect()]
        if symbol is None:
            head = F.when(F.col("kind").isin("script_class", "scene", "project"), 0).when(F.col("address_kind") == "resource_main", 0).otherwise(1)
            return [r.asDict() for r in nodes.where((F.col("file_path") == file) & (F.coalesce("address_kind", F.lit("")) != "resource_external_ref")).orderBy(head, "start_line", "id").limit(200).collect()]
        inside = nodes if file is None else nodes.where(F.col("file_path") == file)
        found = search.run(inside, [(symbol, 20)]).get((symbol.strip(), 20), [])
        exact = lambda n: 0 if n["name"] == symbol else 1 if n["qualified_name"] == symbol else 2
        best = sorted(found, key=lambda n: (exact(n), n["place"]))[:1]
        return best

    def node(self, *, id: str | None = None, file: str | None = None, symbol: str | None = None, offset: int | None = None, limit: int = 200, notes: bool = True, symbols_only: bool = False) -> dict:  # noqa: A002
        """One node with its notes and source; a file alone gives its symbols too. An id stands alone; a
        symbol may be narrowed by file."""
        if (id is None) == (file is None and symbol is None):
            raise ValueError("give an id, or a file and/or a symbol")
        nodes = self.table("nodes")
        found = self._targets(nodes, id, file, symbol)
        if not found:
            return {"ok": False, "error": "not_found"}
        target, symbols = found[0], [n for n in found[1:] if n["kind"] in O.SYMBOLS]
        groups: dict[str, dict] = {}
        if notes and not symbols_only:
            edges = self.table("edges")
            one = self.spark.createDataFrame([(target["id"],)], "id string")
            rows = G.notes(N.visible(N.touching(edges, one), nodes, edges), one, nodes)
            full = rows.join(nodes.withColumnsRenamed({"id": "neighbour", "kind": "n_kind"}), "neighbour")
            for r in full.orderBy("group", "place").collect():
                n = r.asDict()
                groups.setdefault(n["group"], {"items": [], "omitted": n["omitted"]})["items"].append({**n, "id": n["neighbour"], "kind": n["n_kind"], "via": n["kind"]})
        source = None if symbols_only or not target["file_path"] else self._source(nodes, target, offset, limit)
        stale = [p for p in self.stale() if p == target["file_path"]]
        return O.finish_node(target, symbols, groups, source, stale)

    def _source(self, nodes: DataFrame, target: dict, offset: int | None, limit: int) -> dict:
        start = offset or target["start_line"] or 1
        after = nodes.where((F.col("file_path") == target["file_path"]) & (F.col("start_line") > start) & F.col("kind").isin("method", "property", "signal", "inner_class")).agg(F.min("start_line")).first()[0]
        whole = target["kind"] not in ("method", "property", "signal")
        count = min(limit, after - start) if after and offset is None and not whole else limit
        rows = project_files.source_window(self.table("files"), target["file_path"], start, max(1, count)).collect()
        return {"path": target["file_path"], "start": start, "end": rows[-1]["line"] if rows else start, "lines": [f"{r['line']}\t{r['text']}" for r in rows]}

    def serve(self, changes: DataFrame, checkpoint: str, available_now: bool = True):
        """Catches up, then syncs whenever watched files have changed."""
        from graphwright.streaming import watch

        if not self.sync()["ok"]:
            return None

        def batch(rows: DataFrame, _: int) -> None:
            paths = [r["path"] for r in rows.select("path").distinct().limit(10_000).collect()]
            self.mark(*paths)
            if paths:
                self.sync()

        return watch.run(changes, batch, checkpoint, available_now)

    def clean(self) -> bool:
        return self.state.clean()
