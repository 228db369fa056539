"""Incremental operation: a stream of file changes, pending state, debounced syncs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphwright.sources.project_files import IGNORED_SUFFIXES

#: Path segments whose changes are not watched, and the debounce.
UNWATCHED = (".graphwright", ".git", ".godot", ".import", "build", "dist", "node_modules")
DEBOUNCE = "250 milliseconds"


def watched(changes: DataFrame, path: str = "path") -> DataFrame:
    inside = "(^|/)(" + "|".join(p.replace(".", r"\.") for p in UNWATCHED) + ")(/|$)"
    rows = changes.where(~F.rlike(path, F.lit(inside)))
    for suffix in IGNORED_SUFFIXES:
        rows = rows.where(~F.endswith(path, F.lit(suffix)))
    return rows


def pending(changes: DataFrame, keys: tuple[str, ...] = ("root", "path"), ts: str = "ts") -> DataFrame:
    """Last change of every path; works on batches and, in update mode, on streams."""
    return changes.groupBy(*keys).agg(F.max(ts).alias("last"), F.count("*").alias("changes"))


def debounced(changes: DataFrame, gap: str = DEBOUNCE, late: str = "10 seconds") -> DataFrame:
    """One row a burst of changes of a root: bursts end after ``gap`` without a change. Time stamps
    must be of type timestamp; late rows are dropped after ``late``, a later sync finds them."""
    return changes.withWatermark("ts", late).groupBy("root", F.session_window("ts", gap).alias("burst")).agg(F.count("*").alias("changes"), F.collect_set("path").alias("paths"))


def run(changes: DataFrame, sync: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Feeds each micro batch of watched changes to sync, which must be idempotent: a batch that was
    interrupted comes again."""
    writer = watched(changes).writeStream.foreachBatch(sync).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def change_stream(spark: SparkSession, path: str, schema: str = "root string, path string, ts timestamp") -> DataFrame:
    return spark.readStream.schema(schema).json(path)
