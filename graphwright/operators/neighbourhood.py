"""The one-hop neighbourhood of a few seeds: visible edges, open references, bounded samples of both.
Seeds are literal rows; nodes, edges and references stay distributed until they are limited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.functions.text import relation_priority
from graphwright.operators.relational import first_wins, topk_per_group

#: Most nodes, relationships and direct paths of a context, resources of one file.
NODES, RELATIONS, PATHS, RESOURCES = 60, 80, 12, 2
PROMOTED = ("attaches_script", "instantiates_scene", "loads_resource")
SAME_KIND = ("calls", "connects_signal", "emits_signal", "extends", "loads_resource", "main_scene", "preloads_resource", "references_symbol", "references_nodepath", "uses_autoload", "uses_input_action")


def visible(some: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """some of the edges, without parser edges to a resource whose file the resolver has reached from
    the same source by the same kind; a loaded script is also reached if the source, or a node that it
    contains, has the script attached."""
    target = nodes.select(F.col("id").alias("target"), F.col("kind").alias("t_kind"), F.col("file_path").alias("t_file"))
    better = edges.where((F.col("provenance") == "resolver") & F.col("kind").isin(*PROMOTED)).join(target, "target").select("source", "kind", "t_file")
    attached = better.where("kind = 'attaches_script'").select("source", "t_file")
    lifted = edges.where("kind = 'contains'").select("source", F.col("target").alias("child")).join(attached.withColumnRenamed("source", "child"), "child").select("source", "t_file")
    load = F.col("kind") == "loads_resource"
    weak = F.coalesce((F.col("provenance") == "resource-parser") & F.col("kind").isin(*PROMOTED) & (F.col("t_kind") == "resource") & (~load | F.endswith("t_file", F.lit(".gd"))), F.lit(False))
    rows = some.join(target, "target", "left").withColumn("weak", weak)
    by_kind = better.where("kind <> 'loads_resource'").unionByName(attached.unionAll(lifted).withColumn("kind", F.lit("loads_resource"))).distinct()
    kept = rows.where("weak").join(by_kind, ["source", "kind", "t_file"], "left_anti")
    return rows.where("not weak").unionByName(kept.select(*rows.columns)).select(*some.columns)


def touching(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    ids = seeds.select("id")
    ends = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns))
    return ends.distinct()


def still_open(refs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """refs that are not resolved, also not by an edge of their source that says the same."""
    refs = refs.where("not resolved")
    root = (F.col("kind") == "references_nodepath") & F.coalesce(F.col("target") == "root", F.lit(False))
    kinds = F.when(F.col("kind") == "autoload_resource", F.array(F.lit("loads_resource"))).when(root, F.array(F.lit("references_nodepath"), F.lit("uses_autoload"))).when(F.col("kind").isin(*SAME_KIND), F.array("kind"))
    asked = refs.select("path", "ord", "from_id", F.col("kind").alias("r_kind"), F.col("name").alias("r_name"), root.alias("root"), F.explode(kinds).alias("kind"))
    hits = asked.join(edges.select(F.col("source").alias("from_id"), "kind", F.col("target").alias("id")), ["from_id", "kind"]).join(nodes.select("id", F.col("kind").alias("n_kind"), "name", "qualified_name", "file_path"), "id")
    ending = lambda mark: F.endswith("id", F.concat(F.lit(mark), "r_name"))
    auto = F.col("root") & (F.col("n_kind") == "autoload") & (F.col("name") == F.regexp_extract("r_name", "^(?:/root/)?([^/]*)", 1))
    same = (F.col("name") == F.col("r_name")) | (F.col("qualified_name") == F.col("r_name")) | F.coalesce(F.col("file_path") == F.col("r_name"), F.lit(False)) | ending(":") | (F.col("r_kind") == "references_nodepath") & (ending("/") | auto)
    return refs.join(hits.where(same).select("path", "ord").distinct(), ["path", "ord"], "left_anti").select(*refs.columns)


def priority(kind: Column, target: Column, provenance: Column) -> Column:
    """Rank of a relationship: open references and members come late."""
    member = (kind == "contains") & (F.startswith(target, F.lit("method:")) | F.startswith(target, F.lit("property:")))
    return F.when(provenance == "unresolved", 60).when(member, 80).otherwise(relation_priority(kind))


def hop(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, refs: DataFrame, anchors: list[str]) -> DataFrame:
    """(at, part, source, kind, target, provenance, other): all that touches the seeds (at, id, name,
    qualified_name), by seed: incoming, outgoing, open references from it and, without anchors, to its
    names. With anchor files, resources of other files do not count as neighbours."""
    near = visible(touching(edges, seeds), nodes, edges)
    s = seeds.select("at", F.col("id").alias("seed"), F.col("name").alias("s_name"), F.col("qualified_name").alias("s_qualified"))
    shape = ("at", "part", "source", "kind", "target", "provenance", "other")
    into = near.join(s, F.col("target") == F.col("seed")).withColumn("part", F.lit(0)).withColumn("other", F.col("source")).select(*shape)
    out = near.join(s, F.col("source") == F.col("seed")).withColumn("part", F.lit(1)).withColumn("other", F.col("target")).select(*shape)
    both = into.unionByName(out).join(nodes.select(F.col("id").alias("other"), F.col("kind").alias("o_kind"), F.col("file_path").alias("o_file")), "other")
    if anchors:
        both = both.where((F.col("o_kind") != "resource") | F.coalesce(F.col("o_file").isin(*anchors), F.lit(False)))
    names = seeds.select("id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name"))
    mine = refs.join(seeds.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(*refs.columns)
    if not anchors:
        mine = mine.unionByName(refs.join(names.select("name"), "name", "left_semi").select(*refs.columns)).distinct()
    mine = still_open(mine, nodes, edges).select("from_id", F.col("kind").alias("r_kind"), F.col("name").alias("r_name"))
    said = lambda part, other: (F.lit(part).alias("part"), F.col("from_id").alias("source"), F.col("r_kind").alias("kind"), F.col("r_name").alias("target"), F.lit("unresolved").alias("provenance"), other.alias("other"))
    rows = both.select(*shape).unionByName(mine.join(s, F.col("from_id") == F.col("seed")).select("at", *said(2, F.lit(None).cast("string"))))
    if not anchors:
        named = ((F.col("r_name") == F.col("s_name")) | (F.col("r_name") == F.col("s_qualified"))) & (F.col("from_id") != F.col("seed"))
        rows = rows.unionByName(mine.join(s, named).select("at", *said(3, F.col("from_id"))))
    return rows


INDEX = ("at", "part", "source", "kind", "target")


def relationships(rows: DataFrame, limit: int | None = RELATIONS) -> DataFrame:
    """The distinct relationships of a hop by priority, then by first appearance; all of them where
    limit is None."""
    first = first_wins(rows, ["source", "kind", "target", "provenance"], list(INDEX))
    rank = priority(F.col("kind"), F.col("target"), F.col("provenance"))
    kept = first.withColumn("priority", rank).orderBy("priority", *INDEX)
    return (kept if limit is None else kept.limit(limit)).select("source", "kind", "target", "provenance", "priority")


def related(seeds: DataFrame, rows: DataFrame, nodes: DataFrame, limit: int | None = NODES) -> DataFrame:
    """Node rows of the seeds, then of their neighbours by first appearance, two resources a file; all
    of them where limit is None."""
    order = F.struct(F.lit(0).alias("late"), "at", F.lit(0).alias("part"), F.lit("").alias("source"), F.lit("").alias("kind"), F.lit("").alias("target"))
    ids = seeds.select("id", order.alias("order")).unionByName(rows.where("other is not null").select(F.col("other").alias("id"), F.struct(F.lit(1).alias("late"), *INDEX).alias("order")))
    found = ids.groupBy("id").agg(F.min("order").alias("order")).join(nodes, "id")
    main = (F.col("address_kind") == "resource_main") | F.coalesce(F.col("qualified_name") == F.col("file_path"), F.lit(False))
    resources = topk_per_group(found.where("kind = 'resource'").withColumn("file", F.coalesce("file_path", "qualified_name")).withColumn("main", F.when(main, 0).otherwise(1)), ["file"], ["main", "order"], RESOURCES).drop("file", "main")
    kept = found.where("kind <> 'resource'").unionByName(resources).orderBy("order")
    return kept if limit is None else kept.limit(limit)


def paths_between(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = PATHS) -> DataFrame:
    """Visible edges between seeds; containment only where there is nothing else."""
    ids = seeds.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)
    rows = visible(inner, nodes, edges).select("source", "kind", "target", "provenance").distinct()
    rows = rows.withColumn("weak", F.col("kind") == "contains").withColumn("only", F.min("weak").over(_whole()))
    rank = priority(F.col("kind"), F.col("target"), F.col("provenance"))
    return rows.where("weak = only").withColumn("priority", rank).orderBy("priority", "source", "kind", "target").limit(limit).drop("weak", "only")


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # edges between at most a dozen seeds
