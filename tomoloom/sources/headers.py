"""Headers of many volume files, read by tasks into one written table from which a reader's partitions are cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoloom.functions.storage import shared_path
from tomoloom.sources.npy import npy_shape
from tomoloom.sources.tiff import read_directory

HEADER = (
    "path string, kind string, shape array<bigint>, dtype string, "
    "pages array<struct<height: bigint, width: bigint, dtype: string, strips: array<struct<offset: bigint, size: bigint>>, "
    "block: array<bigint>, codec: int, predictor: int, tiled: boolean>>"
)
KINDS = {".npy": "npy_volume", ".tif": "tiff_stack", ".tiff": "tiff_stack"}


def _header(path: str) -> dict:
    suffix = path[path.rfind(".") :].lower()
    kind = KINDS.get(suffix)
    if kind is None:
        raise ValueError(f"Unsupported file type '{suffix}'. Expected .npy, .tif, or .tiff.")
    if kind == "npy_volume":
        shape, dtype = npy_shape(path)
        return {"path": path, "kind": kind, "shape": list(shape), "dtype": dtype.name, "pages": None}
    pages = read_directory(path)
    shape = [len(pages), *pages[0].shape] if pages else [0, 0, 0]
    dtype = np.dtype(pages[0].dtype).name if pages else None
    return {"path": path, "kind": kind, "shape": shape, "dtype": dtype, "pages": [p.row() for p in pages]}


def volume_headers(files: DataFrame, path: str = "path") -> str:
    """Write the headers of all files of a table, one file opened by one task; the table's place.

    Rows are (path, kind, shape, dtype, pages), with byte ranges of the planes where a format scatters them. Give the
    place to a reader as its `headers` option: it then opens no file before its tasks do.
    """
    spark = files.sparkSession
    kind = pa.list_(
        pa.struct(
            [("height", pa.int64()), ("width", pa.int64()), ("dtype", pa.string())]
            + [("strips", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())])))]
            + [("block", pa.list_(pa.int64())), ("codec", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_())]
        )
    )
    schema = pa.schema(
        [("path", pa.string()), ("kind", pa.string()), ("shape", pa.list_(pa.int64())), ("dtype", pa.string()), ("pages", kind)]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 64):
                names = batch.column(0).slice(low, 64).to_pylist()
                yield pa.RecordBatch.from_pylist([_header(name) for name in names], schema=schema)

    place = shared_path(spark)
    dealt = files.select(F.col(path).alias("path")).repartition(2 * spark.sparkContext.defaultParallelism, "path")
    dealt.mapInArrow(read, HEADER).write.partitionBy("kind").parquet(place)
    return place


def lines_of(spark, headers: str, kind: str) -> DataFrame:
    """Lines of voxels of all files of one kind in a header table."""
    return spark.read.format(kind).option("headers", f"{headers}/kind={kind}").load()
