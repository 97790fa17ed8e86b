"""Token files: ids packed at the vocabulary's bit width, with block offsets for random access.

A file holds, one after the other: packed blocks of `BLOCK` ids each (the last one shorter), then the footer: the byte
offset of every block and the end, the documents' ids, a flag per null id, their first token in the file, and the number
of ids; last, a fixed trailer with the place of the footer. Files follow each other in ascending doc_id order.

Files are written by tasks through a file system that every executor reaches. A task writes under a name of its own and
renames the file when it is whole, so a repeated task replaces it by the same bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoloom.functions.storage import shared_folder
from tomoloom.llm.common import prepare, texts
from tomoloom.llm.word_encoder import block_encoder

MAGIC = b"TOKBITS1"
BLOCK = 4096
TRAILER = "<8sBIQQQ"  # magic, bits, block, ids, documents, footer offset
END_ID = 0


def bit_width(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def _lanes(bits: int):
    """Of 64 neighbouring ids, which fill `bits` words of 64 bits: each one's first word, its shift, and whether it goes on."""
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        yield lane, word, np.uint64(shift), shift + bits > 64


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as `bits` bits each, lowest bit first, filled up to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    full = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    full.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(full), bits), "<u8")
    for lane, word, shift, more in _lanes(bits):
        words[:, word] |= full[:, lane] << shift
        if more:
            words[:, word + 1] |= full[:, lane] >> np.uint64(64) - shift
    return words.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    rows = -(-count // 64)
    raw = np.zeros(rows * bits * 8, np.uint8)
    held = np.frombuffer(data, np.uint8, -(-count * bits // 8))
    raw[: len(held)] = held
    words = raw.view("<u8").reshape(rows, bits)
    out = np.empty((rows, 64), np.uint64)
    for lane, word, shift, more in _lanes(bits):
        out[:, lane] = words[:, word] >> shift
        if more:
            out[:, lane] |= words[:, word + 1] << np.uint64(64) - shift
    return (out.reshape(-1)[:count] & np.uint64((1 << bits) - 1)).astype(np.uint32)


class FileWriter:
    """Streams one file: at most a block of ids and the index are held."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.left = np.zeros(0, np.uint32)
        self.blocks, self.docs, self.starts, self.count = [0], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.count)
        self.count += len(ids)
        ids = np.concatenate([self.left, ids])
        full = len(ids) // BLOCK * BLOCK
        for low in range(0, full, BLOCK):
            self._write(ids[low : low + BLOCK])
        self.left = ids[full:]

    def _write(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.blocks.append(self.blocks[-1] + len(data))

    def close(self) -> None:
        if len(self.left):
            self._write(self.left)
        null = np.array([d is None for d in self.docs], np.uint8)
        for part in (
            np.array(self.blocks, "<u8"),
            np.array([0 if d is None else d for d in self.docs], "<i8"),
            null,
            np.array([*self.starts, self.count], "<u8"),
        ):
            self.out.write(part.tobytes())
        self.out.write(struct.pack(TRAILER, MAGIC, self.bits, BLOCK, self.count, len(self.docs), self.blocks[-1]))


class FileReader:
    """Index of one file, and any range of its ids."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        magic, self.bits, self.block, self.count, docs, footer = struct.unpack(
            TRAILER, file.read_at(struct.calcsize(TRAILER), size - struct.calcsize(TRAILER))
        )
        if magic != MAGIC:
            raise ValueError("not a token file")
        rest = file.read_at(size - struct.calcsize(TRAILER) - footer, footer)
        blocks = -(-self.count // self.block) + 1
        self.blocks = np.frombuffer(rest, "<u8", blocks)
        at = blocks * 8
        ids = np.frombuffer(rest, "<i8", docs, at).tolist()
        null = np.frombuffer(rest, np.uint8, docs, at + docs * 8)
        self.docs = [None if n else d for d, n in zip(ids, null)]
        self.starts = np.frombuffer(rest, "<u8", docs + 1, at + docs * 9).astype(np.int64)

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids low to high - 1 of the file; only their blocks are read."""
        if low >= high:
            return np.zeros(0, np.uint32)
        first, last = low // self.block, -(-high // self.block)
        begin, end = int(self.blocks[first]), int(self.blocks[last])
        data = self.file.read_at(end - begin, begin)
        size = self.block * self.bits // 8
        count = min(last * self.block, self.count) - first * self.block
        full = count // self.block
        out = [unpack(data[: full * size], full * self.block, self.bits)] if full else []
        if count % self.block:
            out.append(unpack(data[full * size :], count % self.block, self.bits))
        return np.concatenate(out)[low - first * self.block : high - first * self.block]


def _name(number: int) -> str:
    return f"part-{number:06d}.tok"


def write_files(docs: DataFrame, folder: str, name: str) -> list[tuple[str, int]]:
    """Write one file per range of doc_ids; the files in order, each with its number of ids.

    Texts are dealt out by ranges of doc_id, so no task holds more than its range, and rows that share an id lie together.
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = texts(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = block_encoder(name), np.array([END_ID], np.uint32)
        number, writer, out = TaskContext.get().partitionId(), None, None
        store, path = fs.FileSystem.from_uri(folder)
        final = f"{path}/{_name(number)}"
        own = f"{final}.{uuid.uuid4().hex}"
        for batch in batches:
            ids, ends = codec.encode(batch["text"])
            for doc_id, low, high in zip(batch["doc_id"].to_pylist(), ends, ends[1:]):
                if writer is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(own)
                    writer = FileWriter(out, bit_width(codec.size))
                writer.add(doc_id, np.concatenate([ids[low:high], end]))
        if writer is not None:
            writer.close()
            out.close()
            store.move(own, final)
            yield pa.RecordBatch.from_pydict({"number": [number], "ids": [writer.count]})

    found = ordered.mapInArrow(write, "number long, ids long")
    # One short row per file.
    return [(f"{folder}/{_name(r.number)}", r.ids) for r in sorted(found.collect())]


def read_files(spark, files: list[tuple[str, int]]) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, read back from the files a range of blocks at a time."""
    bases = np.cumsum([0, *(n for _, n in files)])
    plan = spark.createDataFrame(
        [(path, int(base)) for (path, _), base in zip(files, bases)], "path string, base long"
    ).repartition(max(1, len(files)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
                store, local = fs.FileSystem.from_uri(path)
                with store.open_input_file(local) as file:
                    reader = FileReader(file)
                    starts, low = reader.starts, 0
                    docs = len(reader.docs)
                    while low < docs:
                        # Some documents at a time; one that is longer goes through its blocks in pieces.
                        high = max(low + 1, int(np.searchsorted(starts, starts[low] + (1 << 18), "right")) - 1)
                        high = min(high, docs)
                        crc = []
                        if high == low + 1:
                            value = 0
                            for at in range(starts[low], starts[high], 1 << 18):
                                part = reader.ids(at, min(at + (1 << 18), int(starts[high])))
                                value = zlib.crc32(part.tobytes(), value)
                            crc.append(value)
                        else:
                            raw = reader.ids(int(starts[low]), int(starts[high])).tobytes()
                            at = (starts[low : high + 1] - starts[low]) * 4
                            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.docs[low:high], pa.int64()),
                                pa.array(starts[low:high] + base),
                                pa.array(np.diff(starts[low : high + 1])),
                                pa.array(crc, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        low = high

    return plan.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, name: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """Encode, write and read back: one row per document with doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before this one; each document ends with id 0, so null and empty texts have
    one id. Null doc_ids come first; rows that repeat an id lie in the order of their texts. An empty table writes no
    file. `folder` defaults to a new one in the shared folder; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tomoloom-tokens-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}"
    return read_files(spark, write_files(docs, folder, name))
