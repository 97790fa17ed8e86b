"""Files derived from the benchmark tables, written by tasks into the shared folder for the runs that read them back."""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomoloom.functions.paths import located, write_file
from tomoloom.functions.spread import spread_groups, spread_sorted
from tomoloom.functions.storage import discard, materialize, shared_path
from tomoloom.plans import derived as d
from tomoloom.sources.stl import HEADER_BYTES, RECORD

#: Rows and columns of a stored plane.
SIDE = 8


def scan_file(spark: SparkSession, folder: str) -> str:
    """All embeddings as the 8x8 planes of one float `.npy` volume, in the order of their ids."""
    planes = d.table(spark, folder, "embeddings").select(F.col("vec_id").cast("int").alias("z"), "embedding")
    rows = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda y: F.struct(y.alias("y"), F.slice("embedding", y * SIDE + 1, SIDE).alias("run")))
    lines = planes.select("z", F.inline(rows))
    path = shared_path(spark, ".npy")
    shape = f"{planes.count()},{SIDE},{SIDE}"
    lines.write.format("npy_volume").options(shape=shape, dtype="float32").mode("overwrite").save(path)
    return path.removeprefix("file:")


def _grouped(rows: DataFrame, key: str, name: Callable[[object], str], content: Callable[[pa.Table], bytes]) -> str:
    """One file per group, written by the task that has the group; the folder."""
    place = shared_path(rows.sparkSession)

    def write(table: pa.Table) -> pa.Table:
        path = f"{place}/{name(table.column(key)[0].as_py())}"
        write_file(path, content(table))
        return pa.table({"path": [path]})

    materialize(spread_groups(rows, key).groupBy(key).applyInArrow(write, "path string"))
    return place


def tiff_files(spark: SparkSession, folder: str) -> str:
    """Each volume as a 16-bit TIFF stack of its grey levels."""

    def content(table: pa.Table) -> bytes:
        order = np.lexsort([table.column(c).to_numpy() for c in ("x", "y", "z")])
        planes = table.column("g").to_numpy()[order].astype("<u2").reshape(-1, SIDE * SIDE)
        # Header, all pixels, then a directory per plane.
        at, data = 8 + planes.nbytes, [planes.tobytes()]
        fields = lambda k: [(256, SIDE), (257, SIDE), (258, 16), (259, 1), (273, 8 + 2 * SIDE * SIDE * k), (277, 1), (278, SIDE), (279, 2 * SIDE * SIDE), (339, 1)]
        size = 2 + 12 * len(fields(0)) + 4
        for k in range(len(planes)):
            following = at + size * (k + 1) if k + 1 < len(planes) else 0
            entries = b"".join(struct.pack("<HHII", tag, 4, 1, value) for tag, value in fields(k))
            data.append(struct.pack("<H", len(fields(k))) + entries + struct.pack("<I", following))
        return b"II" + struct.pack("<HI", 42, at) + b"".join(data)

    return _grouped(d.volume(spark, folder).select("volume_id", "z", "y", "x", "g"), "volume_id", lambda v: f"{v}.tif", content)


def _stl_head(n: int) -> bytes:
    return b"mesh".ljust(80) + struct.pack("<I", n)


def _in_place(place: str) -> bool:
    """Whether tasks can write at an offset of a file in this folder."""
    return isinstance(located(place)[0], fs.LocalFileSystem)


def _stretches(batch: pa.RecordBatch, corners: list[str]) -> Iterator[tuple[dict, np.ndarray]]:
    """What of a batch follows one another in one mesh: its first row's place and mesh, and the records."""
    meshes = batch.column("mesh_id").dictionary_encode()
    code, at = meshes.indices.to_numpy(), batch.column("at").to_numpy()
    order = np.lexsort([at, code])
    records = np.zeros(len(batch), RECORD)
    records["corners"] = np.stack([batch.column(c).to_numpy()[order] for c in corners], axis=1)
    starts = np.flatnonzero((np.diff(code[order], prepend=-1) != 0) | (np.diff(at[order], prepend=-2) != 1))
    for start, stop in zip(starts, np.append(starts[1:], len(batch)), strict=True):
        row = int(order[start])
        yield {c: batch.column(c)[row].as_py() for c in ("mesh_id", "at", "triangles")}, records[start:stop]


def mesh_files(spark: SparkSession, folder: str) -> str:
    """Each mesh as a binary STL file, its triangles by id.

    Triangles are sorted in ranges and get their place in the file from the ranges' numbers of triangles, so that no task
    holds a mesh: where the shared folder is one of paths, every task writes its own records at their offsets, and a
    repeated attempt writes the same bytes. Elsewhere one task streams a mesh's records in order.
    """
    place = shared_path(spark)
    corners = [f"{v}{axis}" for v in "abc" for axis in "xyz"]
    rows = d.triangles(spark, folder).select("mesh_id", "tri_id", *(F.col(c).cast("float") for c in corners))
    # The number of a row is that of its task, from bit 33 on, and its own in the task.
    ordered = materialize(spread_sorted(rows, "mesh_id", "tri_id").drop("tri_id").withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33).alias("_part")
    ranges = ordered.groupBy("mesh_id", part).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    mesh = Window.partitionBy("mesh_id")
    before = F.coalesce(F.sum("_n").over(mesh.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(ranges.select("mesh_id", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(mesh).alias("triangles")))
    placed = ordered.withColumn("_part", part).join(offsets, ["mesh_id", "_part"])
    placed = placed.select("mesh_id", (F.col("_row") + F.col("_shift")).alias("at"), "triangles", *corners)

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mesh_id, n in zip(batch.column("mesh_id").to_pylist(), batch.column("triangles").to_pylist(), strict=True):
                path = f"{place}/{mesh_id}.stl"
                write_file(path, _stl_head(n))
                os.truncate(located(path)[1], HEADER_BYTES + n * RECORD.itemsize)
            yield pa.RecordBatch.from_pydict({"written": pa.array([len(batch)], pa.int64())})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            for first, records in _stretches(batch, corners):
                with open(located(f"{place}/{first['mesh_id']}.stl")[1], "r+b") as out:
                    out.seek(HEADER_BYTES + first["at"] * RECORD.itemsize)
                    out.write(records.tobytes())
                written += records.size
        yield pa.RecordBatch.from_pydict({"written": pa.array([written], pa.int64())})

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written, of, out = 0, None, None
        for batch in batches:
            for first, records in _stretches(batch, corners):
                if of != first["mesh_id"]:
                    if out:
                        out.close()
                    of, (store, inner) = first["mesh_id"], located(f"{place}/{first['mesh_id']}.stl")
                    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(inner)
                    out.write(_stl_head(first["triangles"]))
                out.write(records.tobytes())
                written += records.size
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"written": pa.array([written], pa.int64())})

    if _in_place(place):
        materialize(offsets.select("mesh_id", "triangles").distinct().mapInArrow(lay_out, "written bigint"))
        materialize(placed.mapInArrow(write, "written bigint"))
    else:
        materialize(spread_groups(placed, "mesh_id").sortWithinPartitions("mesh_id", "at").mapInArrow(stream, "written bigint"))
    discard(ordered)
    return place


def document_paths(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """Each document as a text file under its source and language, with one of five extensions; the folder and the `path` of every file."""
    place = shared_path(spark)
    rows = d.table(spark, folder, "documents").select("source", "lang", "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for r in batch.to_pylist():
                ending = (".TIF", ".npy", ".json", ".stl", "")[r["doc_id"] % 5]
                paths.append(f"{place}/{r['source']}/{r['lang']}/doc_{r['doc_id']}{ending}")
                write_file(paths[-1], r["text"].encode())
            yield pa.RecordBatch.from_pydict({"path": paths})

    return place, materialize(rows.mapInArrow(write, "path string"))


def document_files(spark: SparkSession, folder: str) -> str:
    """The folder of `document_paths`."""
    return document_paths(spark, folder)[0]


def log_files(spark: SparkSession, folder: str, parts: int = 8) -> str:
    """The agent log in as many files as parts: conversations by their number's remainder, each in order."""
    place = shared_path(spark)
    log = d.agent_log(spark, folder).select((F.col("at.conv_id") % parts).alias("part"), "at", "line")
    ordered = log.repartition(parts, "part").sortWithinPartitions("part", "at").select("part", F.col("line").alias("value"))
    ordered.write.partitionBy("part").text(place)
    return place
