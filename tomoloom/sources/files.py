"""Text and file-listing sources built on Spark's own readers."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomoloom.functions.paths import located, open_file
from tomoloom.functions.storage import materialize
from tomoloom.schemas import LATTICE_JSON

READ_BYTES = 1 << 20
#: Files, and bytes of files, that one task reads, about.
FILES_PER_TASK, BYTES_PER_TASK = 4096, 1 << 27
#: Tasks over which the folders of one level are dealt, at most.
MOST_TASKS = 256


def _qualified(spark: SparkSession, root: str):
    """Hadoop file system and absolute path of a folder."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = base.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system, system.makeQualified(base)


def _passed_over(name: str) -> bool:
    """Names that Spark's file readers leave out, too."""
    hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
    return hidden and not name.startswith(("_common_metadata", "_metadata"))


def _entries(batches):
    """Files of the folders in `folder`, and the folders in them, whose length is null."""
    for batch in batches:
        for folder in batch.column("folder").to_pylist():
            store, inner = located(folder)
            names, lengths = [], []
            for entry in store.get_file_info(fs.FileSelector(inner)):
                if not _passed_over(entry.base_name):
                    names.append(f"{folder.rstrip('/')}/{entry.base_name}")
                    lengths.append(None if entry.type == fs.FileType.Directory else entry.size)
            for at in range(0, len(names), FILES_PER_TASK):
                part = slice(at, at + FILES_PER_TASK)
                yield pa.RecordBatch.from_arrays([pa.array(names[part], pa.string()), pa.array(lengths[part], pa.int64())], ["full_path", "length"])


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file below `root`: `path` relative to it, `full_path`, `length`. Contents are not read.

    Tasks list the folders, one level after the other, and write what they find: the driver sees no file's name.
    """
    system, base = _qualified(spark, root)
    if not system.exists(base):
        raise FileNotFoundError(f"no folder at {root}")
    top = base.toString().rstrip("/")
    level, found, folders = spark.createDataFrame([(base.toString(),)], "folder string"), [], 1
    while folders:
        listed = materialize(level.repartition(min(folders, MOST_TASKS)).mapInArrow(_entries, "full_path string, length bigint"))
        found.append(listed.filter("length is not null"))
        level = listed.filter("length is null").select(F.col("full_path").alias("folder"))
        folders = level.count()
    return reduce(DataFrame.unionByName, found).select(F.substring("full_path", len(top) + 2, 1 << 20).alias("path"), "full_path", "length")


def top_folders(spark: SparkSession, root: str) -> DataFrame:
    """Folders directly below `root`, with or without files."""
    system, base = _qualified(spark, root)
    names = [(entry.getPath().getName(),) for entry in system.listStatus(base) if entry.isDirectory()]
    return spark.createDataFrame(names, "folder string").orderBy("folder")


def digest_tree(spark: SparkSession, root: str) -> DataFrame:
    """MD5 of the content of every file below `root`: `(path, length, content_md5)`.

    Every file is streamed by the task that owns its path, whatever its size, through the file system of its scheme.
    """

    def stream(batches):
        for batch in batches:
            digests = []
            for name in batch.column("full_path").to_pylist():
                store, path = located(name)
                digest = hashlib.md5()
                with store.open_input_stream(path) as handle:
                    while block := handle.read(READ_BYTES):
                        digest.update(block)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), batch.column("length"), pa.array(digests, pa.string())],
                ["path", "length", "content_md5"],
            )

    listed = list_tree(spark, root).select("path", "length", "full_path")
    held = listed.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-held.files // FILES_PER_TASK), -(-held.bytes // BYTES_PER_TASK))
    return listed.repartition(tasks).mapInArrow(stream, "path string, length bigint, content_md5 string")


def read_lattice_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per lattice-graph file, with `graph_id` the file path. A file that is no valid JSON is an error."""
    return (
        spark.read.schema(LATTICE_JSON)
        .option("mode", "FAILFAST")
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("graph_id", F.col("_metadata.file_path"))
    )


def read_prompt(spark: SparkSession, path: str) -> DataFrame:
    """One row per prompt file: `(set_id, value)`."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("set_id"), "value")


def read_prompts(paths: DataFrame) -> DataFrame:
    """One row per prompt file of a table of paths: `(set_id, value)`.

    Files are opened by the tasks that hold their paths: the driver lists none of them, and their number sets no number of
    splits. Bytes that are no UTF-8 become replacement characters.
    """

    def read(batches):
        for batch in batches:
            names, texts, held = [], [], 0
            for name in batch.column("path").to_pylist():
                with open_file(name) as handle:
                    texts.append(handle.read().decode(errors="replace"))
                names.append(name)
                held += len(texts[-1])
                if held > READ_BYTES:
                    yield pa.RecordBatch.from_pydict({"set_id": names, "value": texts})
                    names, texts, held = [], [], 0
            if names:
                yield pa.RecordBatch.from_pydict({"set_id": names, "value": texts})

    tasks = max(2 * paths.sparkSession.sparkContext.defaultParallelism, -(-paths.count() // FILES_PER_TASK))
    return paths.select("path").repartition(tasks).mapInArrow(read, "set_id string, value string")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one or more logs: `(at, line)`, where sorting by `at` gives file order. Nothing is moved."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )
    return spark.read.text(path).select(place.alias("at"), F.col("value").alias("line"))


def number_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Turn the `at` of `rows` into `file` and `line_num`, counted from 1 over all `lines`, blank ones included.

    A line's number is its row in the split plus the lines of the file's earlier splits, so only one row per split
    takes part in the running total. Number results, not whole logs: `rows` is what gets joined.
    """
    splits = lines.groupBy("at.file", "at.split").agg(F.min("at.row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        splits.select("file", "split", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    same_split = (F.col("at.file") == offsets["file"]) & (F.col("at.split") == offsets["split"])
    kept = [c for c in rows.columns if c != "at"]
    return rows.join(offsets, same_split).select(
        offsets["file"], (F.col("at.row") + F.col("_shift") + 1).alias("line_num"), *kept
    )
