"""`stl_mesh`: binary STL triangles, split by record range; `stl_counts` reads the headers only."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from tomoloom.functions.paths import open_file
from tomoloom.schemas import TRIANGLE
from tomoloom.sources.binary import Span, list_files, split_spans

# 80 header bytes, a little-endian count, then per triangle normal, three corners, attribute.
HEADER_BYTES = 84
RECORD = np.dtype([("normal", "<f4", 3), ("corners", "<f4", 9), ("attribute", "<u2")])
RECORDS_PER_TASK, RECORDS_PER_BATCH = 1 << 18, 1 << 15


def header_count(path: str) -> int:
    with open_file(path) as handle:
        head = handle.read(HEADER_BYTES)
    return struct.unpack("<I", head[80:84])[0]


class StlMesh(DataSource):
    """Options: `path` (file or folder), `records` (triangles per task). The mesh's id is its file path."""

    @classmethod
    def name(cls) -> str:
        return "stl_mesh"

    def schema(self) -> str:
        return TRIANGLE

    def reader(self, schema) -> StlReader:
        return StlReader(self.options)


class StlReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.files = list_files(options["path"], (".stl",))
        self.records = int(options.get("records", RECORDS_PER_TASK))

    def partitions(self):
        spans = []
        for path in self.files:
            n = header_count(path)
            with open_file(path) as handle:
                size = handle.size()
            if size < HEADER_BYTES + n * RECORD.itemsize:
                raise ValueError(f"{path}: file is shorter than the {n} triangles its header names")
            spans += split_spans(path, n, self.records)
        return spans or [Span("", 0, 0)]

    def read(self, span: Span):
        schema = pa.schema(
            [("mesh_id", pa.string()), ("tri_id", pa.int64())]
            + [(f"{v}{d}", pa.float64()) for v in "abc" for d in "xyz"]
        )
        for start in range(span.start, span.stop, RECORDS_PER_BATCH):
            n = min(RECORDS_PER_BATCH, span.stop - start)
            with open_file(span.path) as handle:
                handle.seek(HEADER_BYTES + start * RECORD.itemsize)
                corners = np.frombuffer(handle.read(n * RECORD.itemsize), RECORD)["corners"].astype(np.float64)
            ids = pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), [span.path]).dictionary_decode()
            columns = [np.ascontiguousarray(corners[:, i]) for i in range(9)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.arange(start, start + n)), *map(pa.array, columns)], schema=schema
            )


def stl_counts(listing: DataFrame) -> DataFrame:
    """Triangle count named by each STL header, from 84 bytes per file; no check against the file length.

    `listing` is a table of `path`s on storage the tasks can open.
    """

    def count(batches):
        for batch in batches:
            paths = batch.column("path")
            counts = [header_count(p.as_py()) for p in paths]
            yield pa.RecordBatch.from_arrays([paths, pa.array(counts, pa.int64())], ["path", "n_triangles"])

    return listing.select(F.col("path").cast("string")).mapInArrow(count, "path string, n_triangles bigint")
