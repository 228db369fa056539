"""The join, distinct and top-k forms from which graph rules are composed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_or_null(targets: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(keys, out) for the keys that name exactly one target; ambiguous keys are left out. The
    aggregate combines map-side, so a name shared by many targets is no hot key."""
    found = targets.groupBy(*keys).agg(F.min(value).alias(out), F.max(value).alias("u_max"))
    return found.where(F.col(out) == F.col("u_max")).drop("u_max")


def coalesce_joins(refs: DataFrame, tiers: Sequence[tuple[DataFrame, Sequence[str], str]], out: str = "target", tier: str | None = "tier") -> DataFrame:
    """Left-joins each (lookup, keys, value column) and keeps the first hit by tier order."""
    for lookup, keys, value in tiers:
        refs = refs.join(lookup.select(*keys, value), list(keys), "left")
    values = [F.col(v) for _, _, v in tiers]
    if tier:
        rank = F.lit(None).cast("int")
        for k in range(len(values) - 1, -1, -1):
            rank = F.when(values[k].isNotNull(), F.lit(k)).otherwise(rank)
        refs = refs.withColumn(tier, rank)
    return refs.withColumn(out, F.coalesce(*values)).drop(*(v for _, _, v in tiers if v != out))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row a key: the first by order, which should end in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("w_rank", F.row_number().over(w)).where("w_rank = 1").drop("w_rank")


def topk_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str | None = None) -> DataFrame:
    """At most k rows a group; Spark prunes groups before the shuffle (window group limit)."""
    name = rank or "w_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def asof_last(df: DataFrame, partition: Sequence[str], order: Sequence[Column | str], value: Column, out: str) -> DataFrame:
    """The last non-null value at or before each row of its partition."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def full_outer_diff(stored: DataFrame, current: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, modified, deleted or unchanged."""
    a = stored.select(F.col(key).alias("a_key"), F.col(content).alias("a_content"))
    b = current.select(F.col(key).alias("b_key"), F.col(content).alias("b_content"))
    change = F.when(F.col("a_key").isNull(), "added").when(F.col("b_key").isNull(), "deleted").when(~F.col("a_content").eqNullSafe(F.col("b_content")), "modified").otherwise("unchanged")
    return a.join(b, F.col("a_key") == F.col("b_key"), "full_outer").select(F.coalesce("a_key", "b_key").alias(key), change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old without the keys of new, plus new."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def intern(df: DataFrame, value: str, first_use: str, prefix: str) -> DataFrame:
    """(value, ref): short names in order of first use. Only for outputs of bounded size: the
    ordinals need one global order."""
    uses = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(first_use).alias("i_first"))
    return uses.select(value, F.concat(F.lit(prefix), F.row_number().over(Window.orderBy("i_first", value)).cast("string")).alias("ref"))
