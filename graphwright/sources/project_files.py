"""Project text files as rows: recursive scan, kind, content hash, lines, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.operators.relational import full_outer_diff

#: Directory names that are pruned at any depth, and ignored suffixes.
PRUNED = (".graphwright", ".git", ".godot", ".import", "addons", "build", "demo", "dist", "node_modules")
IGNORED_SUFFIXES = (".import", ".uid")
MANIFEST = "project.godot"


class NotAProject(ValueError):
    """The root holds no manifest."""


class NotADirectory(ValueError):
    """The root is no folder."""


def file_kind(path: Column) -> Column:
    """project only for the manifest at the root; script, scene and resource by extension; else null."""
    return (
        F.when(path == f"res://{MANIFEST}", "project").when(F.endswith(path, F.lit(".gd")), "gdscript").when(F.endswith(path, F.lit(".tscn")), "scene")
        .when(F.endswith(path, F.lit(".tres")) | F.endswith(path, F.lit("/" + MANIFEST)), "resource")
    )


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, content, content_hash, size, modified_at) of every project file below root, read
    by Spark from any file system; other files are never opened. The hash is over raw bytes."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        raise NotADirectory(root)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gd,tscn,tres,godot}").load(root)
    marker = root.split("://", 1)[-1].rstrip("/") + "/"
    where = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/+", "/")
    relative = F.substring_index(where, marker if marker.startswith("/") else "/" + marker, -1)
    rows = rows.withColumn("relative", F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))))
    inside = "(^|/)(" + "|".join(p.replace(".", r"\.") for p in PRUNED) + ")/"
    rows = rows.where(~F.rlike("relative", F.lit(inside)))
    for suffix in IGNORED_SUFFIXES:
        rows = rows.where(~F.endswith("relative", F.lit(suffix)))
    out = rows.withColumn("path", F.concat(F.lit("res://"), "relative")).withColumn("kind", file_kind(F.col("path"))).where("kind is not null")
    return out.select("path", "kind", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"))


def require_project(files: DataFrame) -> None:
    if files.where(F.col("kind") == "project").isEmpty():
        raise NotAProject(f"missing {MANIFEST}")


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text), lines counted from 1."""
    return files.select("path", F.posexplode(F.split("content", "\r?\n", -1)).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def source_window(files: DataFrame, path: str, offset: int = 1, limit: int = 200) -> DataFrame:
    """Numbered lines of one file from offset on; offset and limit are clamped, limit to 200."""
    first, count = max(1, offset), min(200, max(1, limit))
    return lines(files.where(F.col("path") == path)).where(F.col("line").between(first, first + count - 1)).orderBy("line")


def diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) between two file tables by content hash."""
    return full_outer_diff(stored, current, "path", "content_hash")
