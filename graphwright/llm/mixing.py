"""Operator 1: mixing sources to target weights. DataFrame functions only.

Every row gets a hash-random key; rows are sorted within ranges of that key inside their source,
word counts are prefix-summed in two levels (range totals, then rows inside a range) and each
source is cut at its exact budget. Budgets over a source's size repeat it in whole epochs first.

The ranges are fixed slices of the hash, not sampled boundaries, so a rerun or a lost executor
yields the same ranges; a source with a third of all rows is spread over all its ranges.

Defined results: null text has size 0 and takes 0; a null source is a source, last in order; rows
that tie (same id, source and size) share the cut in an arbitrary but fixed way and are
interchangeable; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, save, text_or_empty

WEIGHTS = (3, 1, 2)
KEY_DIGITS = 6


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share_percent: int = 150, most_times: int = 2, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row per source.

    Water filling: sources sorted by cap over weight fill up first; the level at which the rest
    meets the budget is the fixpoint of resharing the excess: the first, so the highest, level that
    leaves its source open. All windows here see one row a source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), ((place - 1) % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * most_times)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    budget = F.sum("source_size").over(everything) * share_percent / 100
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    filled = caps.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    water = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    return filled.withColumn("water", water).select(
        "source", "source_size", F.when(F.col("water").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight"))).alias("target")
    )


def mix(docs: DataFrame, share_percent: int = 150, most_times: int = 2, weights: Sequence[int] = WEIGHTS, seed: str = "mix", rows_per_range: int = 0) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, start): words each document gives.

    rows_per_range: rows a range should hold; 0 derives the number of ranges from
    spark.sql.shuffle.partitions (four a partition), so that no task sees a large share.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), text_or_empty()))))
    slim = save(docs.select("doc_id", "source", word_count("text").alias("size"), key.alias("key")), "mix")
    if rows_per_range:
        ranges = max(1, slim.count() // rows_per_range)
    else:
        ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(ranges, 16**KEY_DIGITS)
    slim = slim.withColumn("range", F.floor(F.conv(F.substring("key", 1, KEY_DIGITS), 16, 10).cast("long") * ranges / 16**KEY_DIGITS))
    totals = slim.groupBy("source", "range").agg(F.sum("size").alias("words"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), share_percent, most_times, weights)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    targets = targets.withColumnRenamed("source", "t_source")
    starts = starts.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("s_source"), F.col("range").alias("s_range"), "before", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = slim.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("range") == F.col("s_range")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rows = rows.select("doc_id", "size", "source", "source_size", "target", budget.alias("budget"), epochs.alias("epochs"), (F.col("before") + F.col("within")).alias("start"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("start")))
    return rows.select("doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"), "start")


def emit(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """Documents of the mix, whole: one row a repeat. The document at the cut comes in full if the
    cut leaves at least half of it. Rows are matched by doc_id, source and size; rows that share
    these share their copies out: all together get the sum of what each was given, evenly, and the
    remainder one by one to the first of them."""
    copies = taken.where("size > 0").select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), F.round(F.col("taken") / F.col("size")).cast("long").alias("m_copies"))
    copies = copies.groupBy("m_id", "m_source", "m_size").agg(F.sum("m_copies").alias("m_copies"), F.count("*").alias("m_rows")).where("m_copies > 0")
    copies = save(copies.select("m_id", "m_source", "m_size", F.expr("int(m_copies div m_rows)").alias("m_each"), (F.col("m_copies") % F.col("m_rows")).alias("m_rest")), "copies")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("m_row"), word_count("text").alias("m_words"))
    same = F.col("m_row.doc_id").eqNullSafe(F.col("m_id")) & F.col("m_row.source").eqNullSafe(F.col("m_source")) & (F.col("m_words") == F.col("m_size"))
    out = rows.join(copies.where("m_each > 0"), same).select(F.explode(F.array_repeat("m_row", F.col("m_each"))).alias("m_row"))
    rest = copies.where("m_rest > 0")
    if not rest.isEmpty():  # only rows that share doc_id, source and size have a remainder
        place = F.row_number().over(Window.partitionBy("m_id", "m_source", "m_size").orderBy(F.xxhash64("m_row.text")))
        out = out.unionAll(rows.join(rest, same).withColumn("m_place", place).where("m_place <= m_rest").select("m_row"))
    return out.select("m_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document with the words the mix takes from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
                  md5('mix|' || coalesce(doc_id::varchar, 'null ' || coalesce(text, ''))) as key from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3, 1, 2][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as weight, source_size * 2 as cap from s),
v as (select *, ((sum(source_size) over ()) * 150 / 100.0::double - coalesce(sum(cap) over o, 0)::double)
             / ((sum(weight) over ()) - coalesce(sum(weight) over o, 0))::double as level
      from w window o as (order by cap::double / weight, source asc nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, coalesce(least(cap::double, (max(level) filter (where level * weight <= cap) over ()) * weight), cap::double) as target from v),
p as (select d.doc_id, d.size, t.source_size, t.target, floor(t.target)::bigint as budget,
             case when t.source_size > 0 then floor(floor(t.target) / t.source_size)::bigint else 0 end as epochs,
             coalesce(sum(size) over (partition by d.source order by key, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::bigint as taken from p
"""
