"""`tiff_stack`: multi-page TIFF volumes, plain or compressed, in strips or tiles, as lines of voxels, one z plane per page."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tomoloom.functions.paths import open_file
from tomoloom.schemas import LINE
from tomoloom.sources.tiff_blocks import CODECS, DIFFERENCES, NONE, PLAIN, decode_block
from tomoloom.sources.binary import SLAB_VALUES, ZPushdown, ZRange, chosen_files, line_batches, planned_headers

# TIFF tag numbers and field types (TIFF 6.0; type 16 is the 64-bit offset of large files).
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES = 256, 257, 258, 259, 273, 277
ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR, SAMPLE_FORMAT = 278, 279, 317, 339
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
FIELD_TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}


@dataclass
class Page:
    """Where one plane's pixels lie in the file, and how: blocks of one size, line by line, the last ones may reach over."""

    shape: tuple[int, int]
    dtype: str
    strips: list[tuple[int, int]]
    block: tuple[int, int]
    codec: int
    predictor: int
    tiled: bool

    def row(self) -> dict:
        places = [{"offset": offset, "size": size} for offset, size in self.strips]
        return {
            "height": self.shape[0],
            "width": self.shape[1],
            "dtype": self.dtype,
            "strips": places,
            "block": list(self.block),
            "codec": self.codec,
            "predictor": self.predictor,
            "tiled": self.tiled,
        }

    @classmethod
    def from_row(cls, row: dict) -> Page:
        places = [(s["offset"], s["size"]) for s in row["strips"]]
        layout = (tuple(row["block"]), row["codec"], row["predictor"], row["tiled"])
        return cls((row["height"], row["width"]), row["dtype"], places, *layout)

    def read(self, handle) -> np.ndarray:
        """The plane's pixels, one block in memory besides it."""
        height, width = self.shape
        tall, wide = self.block
        out = np.empty(self.shape, np.dtype(self.dtype).newbyteorder("="))
        across = -(-width // wide)
        for k, (offset, size) in enumerate(self.strips):
            y, x = k // across * tall, k % across * wide
            rows = tall if self.tiled else min(tall, height - y)
            handle.seek(offset)
            pixels = decode_block(handle.read(size), self.codec, self.predictor, self.dtype, rows, wide)
            out[y : y + tall, x : x + wide] = pixels[: height - y, : width - x]
        return out


@dataclass
class PageRange(InputPartition):
    path: str
    first: int
    pages: list[Page]


def _field(handle, order: str, code: int, count: int, inline: bytes):
    """Values of one directory field; longer lists sit elsewhere in the file."""
    kind = FIELD_TYPES.get(code)
    if kind is None:
        return ()
    size = struct.calcsize(kind) * count
    if size <= len(inline):
        raw = inline[:size]
    else:
        back = handle.tell()
        handle.seek(struct.unpack(order + ("I" if len(inline) == 4 else "Q"), inline)[0])
        raw = handle.read(size)
        handle.seek(back)
    return struct.unpack(f"{order}{count}{kind}", raw)


def _page(order: str, tags: dict[int, tuple], path: str) -> Page:
    def one(tag: int, default: int) -> int:
        return tags.get(tag, (default,))[0]

    if one(COMPRESSION, NONE) not in CODECS:
        raise ValueError(f"{path}: unsupported TIFF compression {one(COMPRESSION, NONE)}")
    tiled = TILE_WIDTH in tags
    offsets, sizes = (TILE_OFFSETS, TILE_BYTES) if tiled else (STRIP_OFFSETS, STRIP_BYTES)
    if offsets not in tags or sizes not in tags:
        raise ValueError(f"{path}: a TIFF page does not say where its pixels are")
    if one(SAMPLES, 1) != 1:
        raise ValueError(f"{path}: expected one sample per pixel, got {one(SAMPLES, 1)}")
    height, width, bits = one(HEIGHT, 0), one(WIDTH, 0), one(BITS, 1)
    letter = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1))
    if letter is None or bits not in (8, 16, 32, 64):
        raise ValueError(f"{path}: unsupported pixel type ({bits} bits)")
    predictor = one(PREDICTOR, PLAIN)
    if predictor not in (PLAIN, DIFFERENCES) or (predictor == DIFFERENCES and letter == "f"):
        raise ValueError(f"{path}: unsupported TIFF predictor {predictor}")
    strips = list(zip(tags[offsets], tags[sizes], strict=True))
    # Without a number of lines a strip holds them all.
    block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS_PER_STRIP, height), height) or 1, width)
    if len(strips) < -(-height // max(block[0], 1)) * -(-width // max(block[1], 1)):
        raise ValueError(f"{path}: a TIFF page names too few strips or tiles")
    return Page((height, width), f"{order}{letter}{bits // 8}", strips, block, one(COMPRESSION, NONE), predictor, tiled)


def read_directory(path: str) -> list[Page]:
    """All pages of a file, found by following the chain of page directories; pixels are not touched."""
    pages = []
    with open_file(path) as handle:
        order = {b"II": "<", b"MM": ">"}.get(handle.read(2))
        version = struct.unpack((order or "<") + "H", handle.read(2))[0]
        if order is None or version not in (42, 43):
            raise ValueError(f"{path}: not a TIFF file")
        wide = version == 43
        if wide:
            handle.read(4)
        offset_code, count_code, entry = ("Q", "Q", "HHQ8s") if wide else ("I", "H", "HHI4s")

        def number(code: str) -> int:
            return struct.unpack(order + code, handle.read(struct.calcsize(order + code)))[0]

        following = number(offset_code)
        while following:
            handle.seek(following)
            tags = {}
            for _ in range(number(count_code)):
                tag, code, count, inline = struct.unpack(
                    order + entry, handle.read(struct.calcsize(order + entry))
                )
                tags[tag] = _field(handle, order, code, count, inline)
            following = number(offset_code)
            pages.append(_page(order, tags, path))
    return pages


class TiffStack(DataSource):
    """Options: `path` (file or folder), `files` (one path per line) or `headers` (see `sources.headers`), `pages` (planes per task),
    `z_from` and `z_to` (planes to read, the last one excluded).

    The volume's id is its file path.
    """

    @classmethod
    def name(cls) -> str:
        return "tiff_stack"

    def schema(self) -> str:
        return LINE

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


class TiffReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.planned = planned_headers(options)
        self.files = chosen_files(options, (".tif", ".tiff")) if self.planned is None else []
        self.per_task = int(options["pages"]) if "pages" in options else None
        self.z = ZRange(options)

    def partitions(self):
        ranges = []
        if self.planned is None:
            listed = ((path, read_directory(path)) for path in self.files)
        else:
            listed = ((row["path"], [Page.from_row(p) for p in row["pages"]]) for row in self.planned)
        for path, pages in listed:
            if not pages:
                continue
            high = len(pages) if self.z.high is None else min(len(pages), self.z.high)
            height, width = pages[0].shape
            step = self.per_task or max(1, SLAB_VALUES // max(1, height * width))
            for first in range(max(0, self.z.low), high, step):
                ranges.append(PageRange(path, first, pages[first : min(first + step, high)]))
        return ranges or [PageRange("", 0, [])]

    def read(self, part: PageRange):
        if not part.pages:
            return
        with open_file(part.path) as handle:
            for z, page in enumerate(part.pages, start=part.first):
                yield from line_batches(part.path, z, page.read(handle))


class PruningTiffReader(ZPushdown, TiffReader):
    """The same where comparisons of `z` arrive from the query."""


class PruningTiffStack(TiffStack):
    def reader(self, schema) -> PruningTiffReader:
        return PruningTiffReader(self.options)
