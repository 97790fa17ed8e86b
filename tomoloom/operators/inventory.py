"""File inventory: extensions, folders, content duplicates. Input is a table with `path` (relative to its root)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoloom.functions.skew import hot_keys, salted_join
from tomoloom.functions.storage import materialize
from tomoloom.functions.text import file_extension

VOLUME_EXTENSIONS = (".tif", ".tiff", ".npy")


def describe_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Add `ext` and the top-level `folder` (null for files directly under the root)."""
    relative = F.col(path)
    folder = F.when(F.instr(relative, "/") > 0, F.substring_index(relative, "/", 1))
    return files.withColumns({"ext": file_extension(relative), "folder": folder})


def extension_counts(files: DataFrame) -> DataFrame:
    label = F.when(F.col("ext") == "", "(no ext)").otherwise(F.col("ext"))
    return files.groupBy(label.alias("ext")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "ext")


def folders(files: DataFrame) -> DataFrame:
    """Distinct top-level folders that hold at least one file."""
    return files.filter(F.col("folder").isNotNull()).select("folder").distinct().orderBy("folder")


def volume_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("ext").isin(*VOLUME_EXTENSIONS))


def duplicates(digests: DataFrame, rows_per_task: int = 1_000_000) -> DataFrame:
    """Mark every file with the first path (byte order) of the same content.

    Adds `first_path` and `is_duplicate`. Copies are counted by a partial aggregation; the join back spreads any
    content with more than `rows_per_task` copies. `digests` is read twice: pass a written table, not file contents.
    """
    firsts = materialize(
        digests.groupBy("content_md5").agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("copies"))
    )
    hot = hot_keys(firsts, ["content_md5"], "copies", rows_per_task)
    marked = salted_join(
        digests, firsts.select("content_md5", "first_path"), ["content_md5"], hot, spread=["path"]
    )
    return marked.withColumn("is_duplicate", F.col("path") != F.col("first_path"))
