"""What the binary sources share: file listing, row ranges as partitions, line batches."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyarrow.dataset import dataset
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan
from pyspark.sql.datasource import LessThanOrEqual

from tomoloom.functions.paths import located

BATCH_VALUES = 1 << 18
SLAB_VALUES = 1 << 21


@dataclass
class Span(InputPartition):
    """Rows `start <= i < stop` along the first axis of one file."""

    path: str
    start: int
    stop: int


def list_files(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The file itself, or every file below a folder with one of the suffixes, in byte order."""
    store, inner = located(path)
    shown = inner if isinstance(store, fs.LocalFileSystem) else path.rstrip("/")
    kind = store.get_file_info(inner).type
    if kind == fs.FileType.File:
        suffix = os.path.splitext(inner)[1].lower()
        if suffix not in suffixes:
            raise ValueError(f"Unsupported file type '{suffix}'. Expected {' or '.join(suffixes)}.")
        return [shown]
    if kind != fs.FileType.Directory:
        raise FileNotFoundError(f"input file not found at {shown}")
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    below = [f.path for f in found if f.type == fs.FileType.File and os.path.splitext(f.path)[1].lower() in suffixes]
    return sorted(shown + name.removeprefix(inner) for name in below)


def planned_headers(options) -> list[dict] | None:
    """Rows of the header table that the `headers` option names, by path; None without the option."""
    if "headers" not in options:
        return None
    store, inner = located(options["headers"])
    return dataset(inner, filesystem=store, format="parquet").to_table().sort_by("path").to_pylist()


def chosen_files(options, suffixes: tuple[str, ...]) -> list[str]:
    """Files of the `path` option, or only those of the newline-separated `files` option."""
    if "files" in options:
        return [p for path in sorted(options["files"].split("\n")) for p in list_files(path, suffixes)]
    return list_files(options["path"], suffixes)


def split_spans(path: str, rows: int, rows_per_span: int, low: int = 0, high: int | None = None) -> list[Span]:
    stop = rows if high is None else min(rows, high)
    step = max(1, rows_per_span)
    first = max(0, low)
    return [Span(path, s, min(s + step, stop)) for s in range(first, stop, step)]


class ZRange:
    """Half-open z range, from the options `z_from` and `z_to` and from pushed-down comparisons."""

    def __init__(self, options=None) -> None:
        self.low = int(options["z_from"]) if options and "z_from" in options else 0
        self.high = int(options["z_to"]) if options and "z_to" in options else None

    def _cap(self, high: int) -> None:
        self.high = high if self.high is None else min(self.high, high)

    def absorb(self, condition: Filter) -> bool:
        """Narrow the range by a comparison of `z` with a constant; report whether it was understood."""
        if getattr(condition, "attribute", None) != ("z",) or not isinstance(
            getattr(condition, "value", None), int
        ):
            return False
        k = condition.value
        if isinstance(condition, EqualTo):
            self.low = max(self.low, k)
            self._cap(k + 1)
        elif isinstance(condition, GreaterThan):
            self.low = max(self.low, k + 1)
        elif isinstance(condition, GreaterThanOrEqual):
            self.low = max(self.low, k)
        elif isinstance(condition, LessThan):
            self._cap(k)
        elif isinstance(condition, LessThanOrEqual):
            self._cap(k + 1)
        else:
            return False
        return True


class ZPushdown:
    """Mixed into a reader with a `z` range where the session pushes filters down; elsewhere Spark refuses such readers."""

    def pushFilters(self, filters):
        for condition in filters:
            if not self.z.absorb(condition):
                yield condition


LINE_ARROW = pa.schema(
    [("volume_id", pa.string()), ("z", pa.int32()), ("y", pa.int32()), ("run", pa.list_(pa.float64()))]
)


def line_batches(volume_id: str, z: int, plane: np.ndarray):
    """Lines of one z plane, several to a batch."""
    ny, nx = plane.shape
    lines = max(1, BATCH_VALUES // max(nx, 1))
    for y0 in range(0, ny, lines):
        block = np.ascontiguousarray(plane[y0 : y0 + lines])
        n = block.shape[0]
        offsets = np.arange(n + 1, dtype=np.int32) * nx
        yield pa.RecordBatch.from_arrays(
            [
                pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), [volume_id]).dictionary_decode(),
                pa.array(np.full(n, z, np.int32)),
                pa.array(np.arange(y0, y0 + n, dtype=np.int32)),
                pa.ListArray.from_arrays(offsets, block.reshape(-1).astype(np.float64)),
            ],
            schema=LINE_ARROW,
        )
