"""Packing of tokenised documents into sequences: first-fit decreasing over a tournament tree of bin capacities.

A document longer than a sequence is cut into whole sequences and a rest. Documents are dealt out at random, a task
takes its share in groups of bounded size, and each group's rests are packed by themselves: from the longest to the
shortest, each into the first sequence that has room. The tree holds the room of every sequence and in each inner node
the larger of its children, so the first fit is one walk from the root to a leaf.

Documents are dealt round robin after a sort by hash, so a repeated task gets the same rows, and copies of one row, or
rows without an id, are spread like all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoloom.llm.common import prepare, texts
from tomoloom.llm.word_encoder import block_encoder

SEQUENCE = 1024
END_ID = 0
#: Ids that a task holds at a time; a single longer document is held alone.
GROUP_IDS = 1 << 22
#: Pieces of one Arrow batch.
PIECES = 4096
#: Sequence numbers of one task.
NUMBERS = 1 << 40
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Rooms:
    """Tournament tree over the room left in a row of bins."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put an item into the first bin with room: the bin and the room it had."""
        tree, at = self.tree, 1
        if tree[1] < size:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        leaf, room = at, tree[at]
        tree[at] = room - size
        while at > 1:
            at //= 2
            left, right = tree[2 * at], tree[2 * at + 1]
            larger = left if left > right else right
            if tree[at] == larger:
                break
            tree[at] = larger
        return leaf - self.leaves, room


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; equal items go in their given order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms = Rooms(len(sizes), capacity)
    order = np.argsort(-sizes, kind="stable")
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        bins[item], room = rooms.place(size)
        offsets[item] = capacity - room
    return bins, offsets


def _pack_group(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Pieces of a group, documents in order: document, start, length, sequence, offset; sequences from 0 on."""
    n_pieces = -(-counts // capacity)
    doc = np.repeat(np.arange(len(counts)), n_pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)) * capacity
    length = np.minimum(counts[doc] - start, capacity)
    rest = length < capacity
    sequence, offset = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    sequence[rest], offset[rest] = first_fit_decreasing(length[rest], capacity)
    used = int(sequence[rest].max()) + 1 if rest.any() else 0
    sequence[~rest] = used + np.arange((~rest).sum())
    return doc, start, length, sequence, offset


def _pack_task(name: str, capacity: int, group_ids: int):
    def flush(doc_ids: list, held: list[np.ndarray], counts: np.ndarray, base: int) -> Iterator[pa.RecordBatch]:
        doc, start, length, sequence, offset = _pack_group(counts, capacity)
        # Pieces lie in the order of the ids.
        ids = pa.py_buffer(np.concatenate(held).astype("<u4"))
        ends = np.concatenate([[0], np.cumsum(length)]) * 4
        owners = pa.array(doc_ids, pa.int64())
        for low in range(0, len(doc), PIECES):
            part = slice(low, low + PIECES)
            at = ends[low : low + PIECES + 1]
            raw = pa.py_buffer((at - at[0]).astype(np.int32))
            data = ids.slice(int(at[0]), int(at[-1] - at[0]))
            yield pa.RecordBatch.from_arrays(
                [
                    owners.take(pa.array(doc[part])),
                    pa.array(start[part]),
                    pa.array(length[part]),
                    pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, raw, data]),
                    pa.array(counts[doc[part]]),
                    pa.array(sequence[part] + base),
                    pa.array(offset[part]),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = block_encoder(name)
        base = TaskContext.get().partitionId() * NUMBERS
        doc_ids, held, counts, total = [], [], [], 0
        for batch in batches:
            ids, ends = codec.encode(batch["text"])
            # The end id follows each document.
            held.append(np.insert(ids, ends[1:], END_ID))
            doc_ids += batch["doc_id"].to_pylist()
            counts.append(np.diff(ends) + 1)
            total += len(held[-1])
            if total >= group_ids:
                packed = np.concatenate(counts)
                yield from flush(doc_ids, held, packed, base)
                base += int((-(-packed // capacity)).sum())
                doc_ids, held, counts, total = [], [], [], 0
        if doc_ids:
            yield from flush(doc_ids, held, np.concatenate(counts), base)

    return run


def pack(
    docs: DataFrame, name: str = "byte_bpe_50k.json", capacity: int = SEQUENCE, group_ids: int = GROUP_IDS
) -> DataFrame:
    """Pieces of all documents and where they lie: `PIECE`, one row per piece.

    `ids` are the piece's ids, unsigned, four bytes each, little-endian. A sequence is its pieces by offset, gapless from
    0; sequence numbers are distinct over the table, not consecutive. A null or empty text has one id, the end; rows
    with a null or repeated doc_id are packed like all others; the longest text is held by one task; an empty table
    gives no rows. Equal lengths are taken in the order of a hash of their row. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = texts(docs).repartition(parts).sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id")
    return dealt.mapInArrow(_pack_task(name, capacity, group_ids), PIECE)


def with_digests(packed: DataFrame) -> DataFrame:
    """Pieces with the unsigned crc32 of their ids in place of the ids."""
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
