"""Search, ranking and one-hop expansion over node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.functions.text import basename, field_score, kind_priority, relation_priority
from graphwright.operators.relational import first_wins, topk_per_group, unique_or_null

SEARCH_FIELDS = ("id", "name", "qualified_name", "file_path", "basename", "metadata")


def search(nodes: DataFrame, terms: list[str], limit: int | None = 20) -> DataFrame:
    """Nodes by tiered score: prior of the kind plus, for each term, the best tier of its fields.
    Terms are literals (at most 48), so the scan is one pass without a join; wildcards do not exist."""
    rows = nodes.withColumn("basename", basename(F.col("file_path")))
    fields = [f for f in SEARCH_FIELDS if f in rows.columns]
    # each field is lowered once, and rows that hold no term anywhere are dropped before any tier is tried
    rows = rows.withColumn("lowered", F.struct(*(F.lower(f).alias(f) for f in fields)))
    held = reduce(lambda x, y: x | y, (F.coalesce(F.instr(F.col("lowered")[f], term.lower()) > 0, F.lit(False)) for f in fields for term in terms), F.lit(False))
    rows = rows.where(held)
    score = kind_priority(F.col("kind"))
    for term in terms:
        score = score + F.greatest(*(field_score(F.col(f), F.lit(term), F.col("lowered")[f]) for f in fields), F.lit(0))
    rows = rows.withColumn("score", score).drop("basename", "lowered")
    return rows.orderBy(F.desc("score"), "qualified_name", "id").limit(limit) if limit else rows


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges that touch a node, a self loop counted once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def visible(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without parser edges to a resource whose file a resolver edge of equal source and kind hits."""
    files = nodes.select(F.col("id").alias("target"), F.col("file_path").alias("t_file"))
    typed = edges.join(files, "target", "left")
    better = typed.where("provenance = 'resolver'").select("source", "kind", "t_file").distinct()
    parser = typed.where("provenance <> 'resolver'").join(better, ["source", "kind", "t_file"], "left_anti")
    return parser.unionByName(typed.where("provenance = 'resolver'")).drop("t_file")


def expand(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, direction, kind, neighbour, priority) of every edge that touches a seed: one pass over the
    edges, each turned into its two ends; the seeds are few, so the join filters the scan."""
    s = seeds.select(F.col("id").alias("seed"))
    end = lambda to, of, way: F.struct(F.col(to).alias("seed"), F.lit(way).alias("direction"), F.col(of).alias("neighbour"))
    ends = edges.select("kind", F.explode(F.array(end("target", "source", "in"), end("source", "target", "out"))).alias("e")).select("e.seed", "e.direction", "kind", "e.neighbour")
    return ends.join(s, "seed").select("seed", "direction", "kind", "neighbour").withColumn("priority", relation_priority(F.col("kind")))


def notes(edges: DataFrame, targets: DataFrame, nodes: DataFrame, top: int = 8) -> DataFrame:
    """Four groups of neighbours a target: callers, callees, dependents, dependencies; sorted by
    priority, one row a neighbour, the first ``top`` of each, with the number left out."""
    behaviour = F.col("kind").isin("calls", "connects_signal", "emits_signal")
    both = expand(targets, edges)
    group = F.when(behaviour, F.when(F.col("direction") == "in", "callers").otherwise("callees")).otherwise(F.when(F.col("direction") == "in", "dependents").otherwise("dependencies"))
    files = nodes.select("id", "file_path")
    rows = both.join(files.withColumnsRenamed({"id": "seed", "file_path": "f1"}), "seed", "left").join(files.withColumnsRenamed({"id": "neighbour", "file_path": "f2"}), "neighbour", "left")
    cross, symbol = ~F.col("f1").eqNullSafe(F.col("f2")), F.col("kind") == "references_symbol"
    rank = F.when(symbol & cross, 0).when(symbol, 10).when(behaviour & cross, 20).when(behaviour, 30).when(F.col("kind") == "contains", 60).when(cross, 40).otherwise(50)
    rows = rows.withColumn("group", group).withColumn("priority", rank)
    rows = first_wins(rows, ["seed", "group", "neighbour"], ["priority", "kind"])
    counts = rows.groupBy("seed", "group").agg(F.greatest(F.count("*") - top, F.lit(0)).alias("omitted"))
    return topk_per_group(rows, ["seed", "group"], ["priority", "neighbour"], top, "place").join(counts, ["seed", "group"]).select("seed", "group", "place", "neighbour", "kind", "priority", "omitted")


def resolve_names(refs: DataFrame, targets: DataFrame, tiers: list[list[str]], value: str = "id") -> DataFrame:
    """refs with target and tier: the first tier whose keys name exactly one target."""
    from graphwright.operators.relational import coalesce_joins

    return coalesce_joins(refs, [(unique_or_null(targets, keys, value, f"t_{k}"), keys, f"t_{k}") for k, keys in enumerate(tiers)])
