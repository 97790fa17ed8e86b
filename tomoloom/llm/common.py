"""Shared helpers: narrow inputs, runs of whole texts as byte arrays, word ids, 64-bit mixing."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoloom.functions.storage import discard, materialize

#: Rows of an Arrow batch. Texts may be long, and a batch is held whole on both sides.
BATCH_ROWS = 512
#: Bytes of text that one numpy pass works on; a single longer text is passed alone.
BLOCK_BYTES = 1 << 20
#: Bytes around a text's end that a pass may read without meaning.
PAD = 8

# The finalising constants of SplitMix64.
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_byte = np.arange(256, dtype=np.uint8)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
IS_SPACE = (_byte == 32) | ((_byte >= 9) & (_byte <= 13))


def worker_cache() -> dict:
    """A dict that lives as long as the Python process: code that is shipped by value has fresh globals in every task."""
    return sys.__dict__.setdefault("_tomoloom_llm", {})


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small enough that a batch of very long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text, null as empty; every other column is left behind."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def names_one_row(docs: DataFrame) -> bool:
    """Whether every row has an id of its own."""
    seen = docs.agg(F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("ids")).first()
    return seen.rows == seen.ids and docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def with_key(docs: DataFrame, key: str) -> DataFrame:
    """`docs` and a number for each row: the id itself where it names one row, else the row's place in a written copy."""
    if names_one_row(docs):
        return docs.withColumn(key, F.col("doc_id"))
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()))


def keyed(docs: DataFrame) -> DataFrame:
    """ref, doc_id, text, with `ref` as in `with_key`."""
    return with_key(texts(docs), "ref").select("ref", "doc_id", "text")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, in place."""
    x ^= x >> np.uint64(30)
    x *= _MIX_1
    x ^= x >> np.uint64(27)
    x *= _MIX_2
    x ^= x >> np.uint64(31)
    return x


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one little-endian number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(PAD, np.uint8)])
    return np.ndarray((len(data),), "<u8", buffer=padded, strides=(1,))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `limit` bytes: the first row, offsets from 0, and the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, len(column))
        yield row, offsets[row : stop + 1] - offsets[row], data[offsets[row] : offsets[stop]]
        row = stop


def word_spans(
    data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a run of texts; start, length and text index of its words, in order.

    A word is a run of bytes that are not in `breaks`; only A-Z are lower-cased.
    """
    low = LOWER[data]
    if not len(data):
        return low, *(np.zeros(0, np.int64) for _ in range(3))
    inside = ~breaks[low]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    length = np.flatnonzero(inside & ~after) + 1 - start
    return low, start, length, np.searchsorted(offsets, start, "right") - 1


def span_ids(low: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit ids of byte strings, eight bytes a step."""
    packed = eight_bytes(low)
    ids = mix(length.astype(np.uint64))
    rows, at, left = np.arange(len(start)), start, length
    while len(rows):
        kept = np.minimum(left, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * kept)
        part = ids[rows] ^ (packed[at] & mask)
        part *= np.uint64(0x9E3779B97F4A7C15)
        ids[rows] = mix(part)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return ids


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of the words of a run of texts, in order, and the index of each one's text."""
    low, start, length, doc = word_spans(data, offsets, breaks)
    return span_ids(low, start, length), doc


#: Bits of a sieve: a bitmap of fixed size that lets all members and some others pass.
SIEVE_BITS = 24
SLICE_WORDS = 1 << 16


def sieve_cell(key: str | Column, bits: int = SIEVE_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def sieve_table(members: DataFrame, key: str, bits: int = SIEVE_BITS) -> np.ndarray:
    """The bitmap of a table's keys as 64-bit words."""
    words = members.select(sieve_cell(key, bits).alias("cell")).selectExpr(
        "shiftright(cell, 6) as word", "shiftleft(1L, cast(cell % 64 as int)) as bit"
    )
    written = materialize(words.groupBy("word").agg(F.bit_or("bit").alias("bit")))
    table = np.zeros(1 << (bits - 6), np.int64)
    # The driver takes the words in slices of fixed size.
    for low in range(0, len(table), SLICE_WORDS):
        part = written.filter(F.col("word").between(low, low + SLICE_WORDS - 1)).toArrow()
        table[part["word"].to_numpy()] = part["bit"].to_numpy()
    discard(written)
    return table


def sieve(members: DataFrame, key: str, bits: int = SIEVE_BITS) -> Callable[[str], Column]:
    """A test on a column that every member of the table passes, and few others while the table is not much larger."""
    held = members.sparkSession.sparkContext.broadcast(sieve_table(members, key, bits))

    def passes(cells: pa.Array) -> pa.Array:
        cell = cells.to_numpy(zero_copy_only=False)
        return pa.array((held.value[cell >> 6] >> (cell & 63) & 1) == 1)

    return lambda column: F.arrow_udf(passes, "boolean")(sieve_cell(column, bits))


class Lookup:
    """Index of 64-bit keys in a list of distinct ones, by open addressing on arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it isn't there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self._home(keys)
        out = self.slots[at].astype(np.int64)
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.slots[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[out[open_]] != keys[open_])]
        return out


class Tally:
    """Counts per key of a task: sorted lists that are merged when they get long."""

    def __init__(self, most: int = 1 << 21):
        self.keys, self.counts, self.held, self.most = [], [], 0, most

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > self.most:
            self.merge()

    def merge(self) -> None:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(at, np.concatenate(self.counts), len(keys)).astype(np.int64)
        self.keys, self.counts, self.held = [keys], [counts], len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All counts; the tally is empty afterwards."""
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.merge()
        found = self.keys[0], self.counts[0]
        self.keys, self.counts, self.held = [], [], 0
        return found
