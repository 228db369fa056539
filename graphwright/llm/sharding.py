"""Operator 5: balanced contiguous shards from global byte-size prefix sums.

Rows (without their texts) are range-partitioned and sorted by doc_id and written with their
partition number; the totals of the partitions give each partition its start, a window inside the
partition gives each row its start. A row goes to the shard that holds its midpoint when all bytes
are cut at equal targets. The written numbers, not the sampled bounds, are what later steps use.

Defined results: null text has size 1; null doc_ids come first; repeated rows are ordered by
checksum and size and are interchangeable beyond; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, text_or_empty

ORDER = ("doc_id", "text_crc32", "size")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, start, place, shard, slot) of every row."""
    spark = docs.sparkSession
    text = text_or_empty()
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = save(slim.repartitionByRange(n, *ORDER).withColumn("part", F.spark_partition_id()), "shard")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    everything = Window.partitionBy()
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("byte0"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("row0"), F.sum("bytes").over(everything).alias("all"))
    totals = save(totals, "totals")  # a row a partition
    inside = Window.partitionBy("part").orderBy(*ORDER)
    rows = parts.withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("number", F.row_number().over(inside) - 1)
    rows = rows.join(F.broadcast(totals), "part").withColumn("start", F.col("byte0") + F.col("within"))
    middle = F.expr(f"((2 * start + size) * {shards}) div (2 * `all`)")
    rows = rows.select("doc_id", "size", "text_crc32", "start", (F.col("row0") + F.col("number")).alias("place"), F.least(middle, F.lit(shards - 1)).cast("int").alias("shard"))
    rows = save(rows, "places")
    firsts = rows.groupBy("shard").agg(F.min("place").alias("first"))
    return rows.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("place") - F.col("first")).drop("first")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: shard and slot of every document under the law of equal bytes."""
    rows = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 byte by byte, over a table made from its polynomial (reflected 0x04C11DB7).
SQL = """
with step as (select list_transform(range(256), lambda i: list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1))) as t),
d as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
c as (select doc_id, octet_length(encode(text))::bigint + 1 as size,
             xor(list_reduce([4294967295] || list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i::int, 2))::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::bigint as text_crc32 from d, step),
p as (select *, sum(size) over (order by doc_id nulls first, text_crc32, size rows unbounded preceding) - size as start, sum(size) over () as total from c),
s as (select *, least((2 * start + size) * 16 // (2 * total), 15)::int as shard from p)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id nulls first, text_crc32, size)::bigint - 1 as slot, cast(null as int) as grown_shard from s
"""
