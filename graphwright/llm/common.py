"""What the operators share: words, scratch tables, connected components.

Scratch tables live below ``spark.checkpoint.dir`` (read from the session; made here only for a
local session that has none), so that every executor and the driver can read them after any of them
is lost.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters of the contracts: space and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"
#: Java and RE2 pattern of one word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only if a local session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="graphwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one intermediate table; removed by release() or at exit."""
    path = f"{scratch_root(spark)}/scratch-{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_release_quietly)
    _scratch.append((spark, path))
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage durably."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # Spark drops shuffle files of finished jobs when the driver collects garbage
    return spark.read.schema(schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m"):
    """Arrow batches of bounded memory for the jobs run inside."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Removes all scratch tables. Only call it when every result has been written."""
    while _scratch:
        spark, path = _scratch.pop()
        delete(spark, path)


def _release_quietly() -> None:
    while _scratch:
        spark, path = _scratch.pop()
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(column, UPPER, UPPER.lower())


def extend_components(known: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of known, a result of components(), and these new links together. Only
    links between components of known are followed, so the work grows with those."""
    label = lambda end, to: known.select(F.col("id").alias(end), F.col("component_id").alias(to))
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    e = e.join(label("u", "cu"), "u", "left").join(label("v", "cv"), "v", "left")
    merged = components(e.select(F.coalesce("cu", "u").alias("a"), F.coalesce("cv", "v").alias("b")))
    moved = known.join(merged.select(F.col("id").alias("component_id"), F.col("component_id").alias("to")), "component_id", "left")
    moved = moved.select("id", F.coalesce("to", "component_id").alias("component_id"))
    # the first label of a component is in both and agrees
    return save(moved.unionAll(merged.select("id", "component_id")).distinct(), "labels")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id): smallest id reachable, for every id on an edge. Distributed min-label
    propagation with pointer jumping; each round is a written table, no links reach the driver.

    Ids are longs and not null; rows with a null end, self links and repeats do no harm.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = save(both, "edges")
    links = taken_paths()[-1]
    labels = save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "labels")
    while True:
        last = taken_paths()[-1]
        near = both.join(labels.select(F.col("u").alias("v"), F.col("l").alias("near")), "v")
        near = near.groupBy("u").agg(F.min("near").alias("near"))
        step = labels.join(near, "u").select("u", "l", F.least("l", "near").alias("p"))
        jump = labels.select(F.col("u").alias("p"), F.col("l").alias("pl"))
        step = step.join(jump, "p", "left").select("u", F.least("p", F.coalesce("pl", "p")).alias("p"), F.col("l").alias("old"))
        step = save(step, "labels")
        release_paths([last])
        if step.where("p <> old").isEmpty():
            release_paths([links])
            return step.select(F.col("u").alias("id"), F.col("p").alias("component_id"))
        labels = step.select("u", F.col("p").alias("l"))


def taken_paths() -> list[tuple[SparkSession, str]]:
    """The scratch tables that exist now."""
    return list(_scratch)


def release_paths(paths: list[tuple[SparkSession, str]]) -> None:
    """Removes these scratch tables. Only call it when all that reads them has been written."""
    for pair in paths:
        if pair in _scratch:
            _scratch.remove(pair)
            delete(*pair)
