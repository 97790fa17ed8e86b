"""`npy_volume`: 3D `.npy` arrays as lines of voxels, read by z slab and written in place by many tasks."""

from __future__ import annotations

import io
import os
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage

from tomoloom.functions.paths import located, open_file
from tomoloom.schemas import LINE
from tomoloom.sources.binary import SLAB_VALUES, Span, ZPushdown, ZRange, chosen_files, line_batches, planned_headers, split_spans


@dataclass
class NpyHeader:
    shape: tuple[int, ...]
    dtype: np.dtype
    fortran: bool
    offset: int


def read_header(handle) -> NpyHeader:
    """What an open `.npy` file holds, from its header alone."""
    version = np.lib.format.read_magic(handle)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(handle)
    return NpyHeader(shape, dtype, fortran, handle.tell())


def npy_shape(path: str) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and dtype from the header alone."""
    with open_file(path) as handle:
        header = read_header(handle)
    return header.shape, header.dtype


def planes(path: str, start: int, stop: int):
    """Planes `start` to `stop - 1` of a 3D file, read a plane at a time; the layout with z innermost is read whole."""
    with open_file(path) as handle:
        head = read_header(handle)
        nz, ny, nx = head.shape
        if head.fortran and min(ny, nx) > 0:
            handle.seek(head.offset)
            whole = np.frombuffer(handle.read(nz * ny * nx * head.dtype.itemsize), head.dtype)
            yield from whole.reshape(head.shape, order="F")[start:stop]
            return
        size = ny * nx * head.dtype.itemsize
        for z in range(start, stop):
            yield np.frombuffer(handle.read_at(size, head.offset + z * size), head.dtype).reshape(ny, nx)


class NpyVolume(DataSource):
    """Options: `path` (file or folder), `files` (one path per line) or `headers` (see `sources.headers`), `slab` (z planes per task),
    `z_from` and `z_to` (planes to read, the last one excluded).

    The volume's id is its file path.
    """

    @classmethod
    def name(cls) -> str:
        return "npy_volume"

    def schema(self) -> str:
        return LINE

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite) -> NpyWriter:
        return NpyWriter(self.options, schema, overwrite)


class NpyReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.planned = planned_headers(options)
        self.files = chosen_files(options, (".npy",)) if self.planned is None else []
        self.slab = int(options["slab"]) if "slab" in options else None
        self.z = ZRange(options)

    def partitions(self):
        spans = []
        if self.planned is None:
            shapes = ((path, npy_shape(path)[0]) for path in self.files)
        else:
            shapes = ((row["path"], row["shape"]) for row in self.planned)
        for path, shape in shapes:
            if len(shape) != 3:
                raise ValueError(f"expected a 3D array, got shape {shape}")
            per_task = self.slab or SLAB_VALUES // max(1, shape[1] * shape[2])
            spans += split_spans(path, shape[0], per_task, self.z.low, self.z.high)
        return spans or [Span("", 0, 0)]

    def read(self, span: Span):
        if span.stop > span.start:
            for z, plane in enumerate(planes(span.path, span.start, span.stop), span.start):
                yield from line_batches(span.path, z, plane)


class PruningNpyReader(ZPushdown, NpyReader):
    """The same where comparisons of `z` arrive from the query."""


class PruningNpyVolume(NpyVolume):
    def reader(self, schema) -> PruningNpyReader:
        return PruningNpyReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    rows: int


class NpyWriter(DataSourceArrowWriter):
    """One dense `.npy` from voxel rows `(z, y, x, value)` or whole lines `(z, y, run)`; absent voxels are 0.

    Options: `path` ending in `.npy` on storage all tasks share, `shape` ("nz,ny,nx"), `dtype`. The driver lays out
    header and size; each task writes its own voxels at their offsets, so a repeated attempt writes the same bytes.
    The file appears under its name only on commit.
    """

    def __init__(self, options, schema, overwrite: bool) -> None:
        self.path = located(options["path"])[1]
        if os.path.splitext(self.path)[1].lower() != ".npy":
            raise ValueError("output_filepath must end with '.npy'")
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        self.shape = tuple(int(n) for n in options["shape"].split(","))
        self.dtype = np.dtype(options.get("dtype", "uint8"))
        self.columns = [f.name for f in schema.fields]
        self.value = next(c for c in self.columns if c not in ("volume_id", "z", "y", "x"))
        self.by_line = "x" not in self.columns
        header = io.BytesIO()
        np.lib.format.write_array_header_1_0(
            header,
            {"descr": np.lib.format.dtype_to_descr(self.dtype), "fortran_order": False, "shape": self.shape},
        )
        self.offset = len(header.getvalue())
        self.draft = f"{self.path}.{os.getpid()}-{id(self)}.draft"
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(self.draft, "wb") as out:
            out.write(header.getvalue())
            out.truncate(self.offset + int(np.prod(self.shape)) * self.dtype.itemsize)

    def _placed(self, batch):
        """Flat position of each first value, values per position, and the values."""
        _, ny, nx = self.shape
        at = {c: batch.column(i) for i, c in enumerate(self.columns)}
        line = at["z"].to_numpy().astype(np.int64) * ny + at["y"].to_numpy()
        if not self.by_line:
            return line * nx + at["x"].to_numpy(), at[self.value].to_numpy(zero_copy_only=False).reshape(-1, 1)
        values = at[self.value].flatten().to_numpy(zero_copy_only=False)
        if values.size != line.size * nx:
            raise ValueError(f"expected lines of {nx} voxels")
        return line * nx, values.reshape(-1, nx)

    def write(self, iterator) -> Written:
        rows = 0
        with open(self.draft, "r+b") as out:
            for batch in iterator:
                place, values = self._placed(batch)
                order = np.argsort(place, kind="stable")
                place, values = place[order], values[order].astype(self.dtype)
                starts = np.flatnonzero(np.diff(place, prepend=-1 - values.shape[1]) != values.shape[1])
                for start, stop in zip(starts, np.append(starts[1:], place.size), strict=True):
                    out.seek(self.offset + int(place[start]) * self.dtype.itemsize)
                    out.write(values[start:stop].tobytes())
                rows += place.size
        return Written(rows)

    def commit(self, messages) -> None:
        os.replace(self.draft, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.draft):
            os.remove(self.draft)
