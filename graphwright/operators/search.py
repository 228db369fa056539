"""Many searches over the node table in one pass: a phrase leg ranked by BM25 and a substring leg
ranked by exactness for every term of every search, each cut to twice the search's limit, then the
tiered score. Searches and their terms are few and literal; nodes are never joined with them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.functions import text as T
from graphwright.operators.relational import topk_per_group

#: Constants of the phrase leg's rank.
K1, B = 1.2, 0.75
FIELDS = ("id", "name", "qualified_name", "file_path")


def without_superseded(nodes: DataFrame) -> DataFrame:
    """Without resources that stand for a script whose class is a node too."""
    scripts = nodes.where("kind = 'script_class'").select("file_path").distinct()
    hidden = (F.col("kind") == "resource") & F.coalesce(F.endswith("file_path", F.lit(".gd")), F.lit(False))
    return nodes.where(~hidden).unionByName(nodes.where(hidden).join(scripts, "file_path", "left_anti").select(*nodes.columns))


def _spaced(text: Column) -> Column:
    """Tokens of letters and digits, lower case, each between spaces, so that phrases are substrings."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def phrases(term: str) -> list[str]:
    """The phrases that a term asks for: one a token, whose parts at underscores must be adjacent."""
    found = []
    for token in _tokens(term):
        if parts := ["".join(c for c in p if c.isalnum()) for p in token.lower().split("_") if p]:
            found.append(" " + "  ".join(parts) + " ")
    return found


def _tokens(text: str) -> list[str]:
    out, held = [], ""
    for c in text + " ":
        if c.isalnum() or c == "_":
            held += c
        elif held:
            out.append(held)
            held = ""
    return out


def search_many(nodes: DataFrame, searches: list[tuple[str, list[str], int]]) -> DataFrame:
    """(search, place, score, node columns): the best ``limit`` nodes of every (query, terms, limit)."""
    wanted = [(k, q, terms, limit) for k, (q, terms, limit) in enumerate(searches) if q.strip() and limit > 0 and terms]
    spark = nodes.sparkSession
    if not wanted:
        return spark.createDataFrame([], nodes.schema).select(F.lit(0).alias("search"), F.lit(0).alias("place"), F.lit(0).alias("score"), *nodes.columns)
    rows = without_superseded(nodes)
    columns = F.struct(*nodes.columns).alias("node")
    rows = rows.select(columns, *FIELDS, T.basename(F.col("file_path")).alias("basename"), *(F.lower(f).alias(f"l_{f}") for f in FIELDS), F.concat(_spaced(F.col("name")), F.lit(" | "), _spaced(F.coalesce("qualified_name", F.lit("")))).alias("spaced"))
    rows = rows.withColumn("length", F.size(F.filter(F.split("spaced", " +"), lambda w: (w != "") & (w != "|"))))
    asked = sorted({p for _, _, terms, _ in wanted for t in terms for p in phrases(t)})
    size, mean = rows.agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(0.0))).first()
    present = F.filter(F.array(*(F.lit(p) for p in asked)), lambda p: F.instr(F.col("spaced"), p) > 0) if asked else F.array().cast("array<string>")
    held = {r["p"]: r["n"] for r in rows.select(F.explode(present).alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    weight = {p: max(1e-6, math.log((size - held.get(p, 0) + 0.5) / (held.get(p, 0) + 0.5))) for p in asked}
    legs = F.array(*(F.struct(F.lit(k).alias("search"), F.lit(at).alias("at"), F.lit(limit).alias("most"), F.lit(t).alias("term"), F.lit(t.lower()).alias("low"), F.array(*(F.struct(F.lit(p).alias("p"), F.lit(weight[p]).alias("w")) for p in phrases(t))).cast("array<struct<p:string,w:double>>").alias("phrases")) for k, _, terms, limit in wanted for at, t in enumerate(terms)))
    inside = lambda s: F.coalesce(sum((F.instr(F.coalesce(F.col(f"l_{f}"), F.lit("")), s["low"]) > 0).cast("int") for f in FIELDS) > 0, F.lit(False))
    spoken = lambda s: (F.size(s["phrases"]) > 0) & F.forall(s["phrases"], lambda p: F.instr(F.col("spaced"), p["p"]) > 0)
    most = 2 * max(limit for *_, limit in wanted)
    found = rows.select("*", F.explode(F.filter(legs, lambda s: inside(s) | spoken(s))).alias("s")).select("*", "s.*")
    times = lambda p: (F.char_length("spaced") - F.char_length(F.replace(F.col("spaced"), p, F.lit("")))) / F.char_length(p)
    rank = F.aggregate("phrases", F.lit(0.0), lambda acc, p: acc + p["w"] * times(p["p"]) * (K1 + 1) / (times(p["p"]) + K1 * (1 - B + B * F.col("length") / F.lit(max(mean, 1e-9)))))
    exact = F.when(F.col("name") == F.col("term"), 0).when(F.col("qualified_name") == F.col("term"), 1).when(F.col("file_path") == F.col("term"), 2).when(F.col("id") == F.col("term"), 3).otherwise(10)
    keep = ["search", "at", "most", "node", "id", "qualified_name"]
    said = topk_per_group(found.where(spoken(found)).withColumn("rank", rank), ["search", "at"], [F.desc("rank"), "qualified_name", "id"], most, "leg_place").select(*keep, F.lit(0).alias("leg"), "leg_place")
    held_in = topk_per_group(found.where(inside(found)).withColumn("rank", exact), ["search", "at"], ["rank", "qualified_name", "id"], most, "leg_place").select(*keep, F.lit(1).alias("leg"), "leg_place")
    both = said.unionAll(held_in).where(F.col("leg_place") <= 2 * F.col("most"))
    first = both.groupBy("search", "id").agg(F.min(F.struct("at", "leg", "leg_place")).alias("index"), F.first("node").alias("node"), F.first("most").alias("most"))
    terms_of = F.create_map(*(x for k, _, terms, _ in wanted for x in (F.lit(k), F.array(*(F.lit(t) for t in terms)))))
    part = lambda f: T.basename(F.col("node.file_path")) if f == "basename" else F.col(f"node.{f}")
    score = F.aggregate(terms_of[F.col("search")], T.kind_priority(F.col("node.kind")), lambda acc, t: acc + F.greatest(*(T.field_score(part(f), t) for f in (*FIELDS, "basename"))))
    first = first.withColumn("score", score).withColumn("q_name", F.col("node.qualified_name"))
    best = topk_per_group(first, ["search"], [F.desc("score"), "index", "q_name"], most, "place").where(F.col("place") <= F.col("most"))
    return best.select("search", "place", "score", "node.*")


def run(nodes: DataFrame, queries: list[tuple[str, int]]) -> dict[tuple[str, int], list[dict]]:
    """The nodes of every distinct (query, limit), best first; at most the sum of limits rows. A query
    of several tokens that finds nothing is tried again by its bare tokens."""
    spark, asked = nodes.sparkSession, sorted({(q.strip(), n) for q, n in queries if q.strip() and n > 0})
    out: dict[tuple[str, int], list[dict]] = {k: [] for k in asked}
    if not asked:
        return out
    rows = spark.createDataFrame([(k, q) for k, (q, _) in enumerate(asked)], "k int, q string").select("k", T.ranking_terms(F.col("q")).alias("terms")).collect()
    terms = {r["k"]: r["terms"] for r in rows}

    def collect(which: list[int], terms: dict[int, list[str]]) -> None:
        found = search_many(nodes, [(asked[k][0], terms[k], asked[k][1]) for k in which])
        for r in sorted((r.asDict() for r in found.collect()), key=lambda r: (r["search"], r["place"])):
            out[asked[which[r["search"]]]].append(r)

    collect(list(range(len(asked))), terms)
    again = [k for k, key in enumerate(asked) if not out[key] and len(_tokens(key[0])) > 1]
    if again:
        collect(again, {k: _tokens(asked[k][0])[:48] for k in again})
    return out
