"""Types of receivers: what class an expression like ``a.b.c`` before a dot stands for.

A root name is a parameter of the containing method, else the last local above it whose type is
known, else a constant that preloads a script, else the one property of that name; each further name
is the one property of that name on the class so far. Locals get their type from a declaration, a
constructor, a cast, a helper's return type, a loop over a typed collection or another receiver.
Everything is joins and as-of windows; only as many rounds run as aliases hang on each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.operators.relational import asof_last, coalesce_joins, unique_or_null


def type_name(declared: Column) -> Column:
    """The first name of a declared type; Variant and none are no type."""
    name = F.regexp_extract(declared, r"^\s*([A-Za-z_]\w*)", 1)
    return F.when((name != "") & (name != "Variant"), name)


def element_type(declared: Column) -> Column:
    """What a typed array holds, or a typed dictionary has as values."""
    name = F.regexp_extract(declared, r"^\s*(?:Array\s*\[|Dictionary\s*\[[^,\]]+,)\s*([A-Za-z_]\w*)\s*\]", 1)
    return F.when((name != "") & (name != "Variant"), name)


def containing_method(rows: DataFrame, nodes: DataFrame, out: str = "scope") -> DataFrame:
    """rows (path, line, ..) with the id of the method of the greatest start at or before the line."""
    methods = nodes.where("kind = 'method'").select(F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.col("id").alias("m_id"), F.lit(0).alias("m_ord"))
    both = rows.withColumn("m_id", F.lit(None).cast("string")).withColumn("m_ord", F.lit(1)).unionByName(methods, allowMissingColumns=True)
    return asof_last(both, ["path"], ["line", "m_ord", "m_id"], F.col("m_id"), out).where("m_ord = 1").drop("m_id", "m_ord")


class Receivers:
    def __init__(self, facts: DataFrame, nodes: DataFrame, hold: Callable[[DataFrame, str], DataFrame] = lambda df, _: df):
        properties = nodes.where("kind = 'property'")
        one = unique_or_null(properties, ["name"], "id", "id").select("id").join(properties, "id")
        self.property = one.select(F.col("name").alias("root"), type_name(F.col("type")).alias("t_property"), element_type(F.col("type")).alias("e_property"))
        on = properties.where(F.size(F.split("qualified_name", r"\.")) == 2).withColumn("on", F.substring_index("qualified_name", ".", 1))
        one = unique_or_null(on, ["on", "name"], "id", "id").select("id").join(on, "id")
        self.on_class = one.select("on", "name", type_name(F.col("type")).alias("then"), element_type(F.col("type")).alias("e_then"))
        scripts = nodes.where("kind = 'script_class'").select(F.col("file_path").alias("target"), F.col("name").alias("t_alias"))
        self.alias = facts.where("fact = 'script_alias'").join(unique_or_null(scripts, ["target"], "t_alias", "t_alias"), "target").groupBy("path", F.col("name").alias("root")).agg(F.min_by("t_alias", "line").alias("t_alias"))
        scoped = containing_method(facts.where("fact in ('parameter', 'local')").select("path", "line", "fact", "name", F.col("receiver").alias("form"), "target"), nodes).where("scope is not null")
        scoped = hold(scoped, "scoped")
        self.parameter = scoped.where("fact = 'parameter'").groupBy("scope", F.col("name").alias("root")).agg(F.min(type_name(F.col("target"))).alias("t_parameter"))
        local = scoped.where("fact = 'local'").drop("fact")
        returns = unique_or_null(nodes.where("kind = 'method'").select(F.col("file_path").alias("path"), F.col("name").alias("target"), "id"), ["path", "target"], "id", "id").join(nodes.where("kind = 'method'").select("id", F.col("type").alias("returned")), "id").drop("id")
        base = local.where("form in ('type', 'cast', 'new', 'return')").join(self.alias.select("path", F.col("root").alias("target"), "t_alias"), ["path", "target"], "left").join(returns, ["path", "target"], "left")
        base = base.withColumn("type", F.when(F.col("form") == "new", F.coalesce("t_alias", type_name(F.col("target")))).when(F.col("form") == "return", type_name(F.col("returned"))).otherwise(type_name(F.col("target"))))
        self.local = hold(base.where("type is not null").select("scope", F.col("name").alias("root"), "line", "type"), "types_0")
        typed = local.where("form = 'type'").select("path", "name", "target").unionAll(facts.where("fact = 'property'").select("path", "name", "target"))
        self.collection = unique_or_null(typed.withColumn("element", element_type(F.col("target"))).where("element is not null"), ["path", "name"], "element", "e_local")
        later = local.where("form in ('alias', 'loop') and target <> name").withColumn("rid", F.concat_ws("|", "path", "line", "name"))
        known, before, rounds = self.local, 0, 0
        while True:
            rounds += 1
            typed = later.join(self.types(later.where("form = 'alias'").withColumn("receiver", F.col("target"))), "rid")
            found = typed.select("scope", F.col("name").alias("root"), "line", "type").unionByName(self._elements(later.where("form = 'loop'")))
            found = hold(found.distinct(), f"types_{rounds}")
            self.local = known.unionByName(found)
            if (n := found.count()) <= before:
                return
            before = n

    def types(self, rows: DataFrame) -> DataFrame:
        """(rid, type) of the rows (rid, path, scope, line, receiver) whose receiver has a type."""
        parts = F.split("receiver", r"\.")
        rows = rows.select("rid", "path", "scope", "line", F.filter(parts, lambda x: x != "").alias("parts")).withColumn("root", F.get("parts", F.lit(0)))
        known = self.local.select("scope", "root", "line", "type").withColumn("k", F.lit(1))
        both = rows.withColumn("k", F.lit(0)).unionByName(known, allowMissingColumns=True)
        rows = asof_last(both, ["scope", "root"], ["line", "k"], F.col("type"), "t_local").where("k = 0").drop("k", "type")
        rows = coalesce_joins(rows, [(self.parameter, ["scope", "root"], "t_parameter")], "t_first", None)
        rows = rows.withColumn("t_first", F.coalesce("t_first", "t_local")).drop("t_local")
        rows = rows.join(self.alias, ["path", "root"], "left").join(self.property.select("root", "t_property"), "root", "left")
        rows = rows.select("rid", "parts", F.coalesce("t_first", "t_alias", "t_property").alias("type")).where("type is not null")
        deepest = rows.agg(F.max(F.size("parts"))).first()[0] or 1
        for k in range(1, deepest):
            step = rows.withColumn("name", F.get("parts", F.lit(k))).join(self.on_class.select(F.col("on").alias("type"), "name", "then"), ["type", "name"], "left")
            rows = step.select("rid", "parts", F.when(F.size("parts") > k, F.col("then")).otherwise(F.col("type")).alias("type")).where("type is not null")
        return rows.select("rid", "type").distinct()

    def _elements(self, loops: DataFrame) -> DataFrame:
        """Types of loop variables: a typed collection of the file, of the receiver's class, or the
        one property of that name."""
        rows = loops.withColumn("last", F.element_at(F.split("target", r"\."), -1)).withColumn("receiver", F.when(F.instr("target", ".") > 0, F.regexp_replace("target", r"\.[^.]*$", "")))
        on = self.types(rows.where("receiver is not null")).withColumnRenamed("type", "on")
        rows = rows.join(self.collection.withColumnRenamed("name", "target"), ["path", "target"], "left").join(on, "rid", "left")
        rows = rows.join(self.on_class.select("on", F.col("name").alias("last"), "e_then"), ["on", "last"], "left").join(self.property.select(F.col("root").alias("last"), "e_property"), "last", "left")
        found = F.coalesce("e_local", F.when(F.col("on").isNotNull(), F.col("e_then")).otherwise(F.col("e_property")))
        return rows.select("scope", F.col("name").alias("root"), "line", found.alias("type")).where("type is not null")
