"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

Words are counted in the texts; the frequent ones are the vocabulary. Its words lie in Bloom filters by their length,
each key inside one 64-bit block. Every word's deletions and replacements are generated on arrays and probed; an
insertion is another word's deletion, so each pair is met from one side at least. Only edits that the filters hold are
shuffled to a join with the vocabulary, which removes the false ones.

The filters of all lengths share one row of blocks. It is broadcast in rounds of at most `ROUND_BLOCKS`, so what a task
holds does not grow with the vocabulary; a round generates edits only for the lengths whose filters it covers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoloom.functions.storage import discard, materialize
from tomoloom.llm.common import LOWER, mix, prepare, span_ids, texts
from tomoloom.llm.terms import pieces, runs

#: Code points a word has at least, and its occurrences.
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent.
RATIO = 5
#: One run in so many loses a letter.
NOISE = 199
#: Bits of filter for each word, in blocks of 64.
BITS = 24
#: Blocks of one round: 8 MB.
ROUND_BLOCKS = 1 << 20
#: Words that a task counts before it passes them on, and words that it probes at once.
HELD = 400_000
PROBED = 20_000
#: Longer runs are hashed one by one.
LONG_RUN = 48

# The letters of words, lower-cased a-z and U+00C0 to U+00FF.
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)])
_SIZE = len(LETTERS)

_ASCII = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_byte = np.arange(256, dtype=np.uint32)
CRC = _byte.copy()
for _ in range(8):
    # Fixed value: the reversed polynomial of crc32.
    CRC = np.where(CRC & 1, CRC >> 1 ^ np.uint32(0xEDB88320), CRC >> 1).astype(np.uint32)


def _letter_runs(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length in bytes and text of the runs of letters."""
    lead = low == 0xC3
    inside = _ASCII[low] | lead
    inside[1:] |= lead[:-1]
    return runs(inside, offsets)


def _points(low: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Code points of the runs: a letter beyond ASCII has two bytes."""
    pairs = np.concatenate([[0], np.cumsum(low == 0xC3)])
    return length - (pairs[start + length] - pairs[start])


def _checksums(low: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each run after a prefix whose checksum is `state`."""
    out = np.empty(len(start), np.uint32)
    short = length <= LONG_RUN
    for k in np.flatnonzero(~short):
        out[k] = zlib.crc32(low[start[k] : start[k] + length[k]].tobytes(), int(state[k]))
    order = np.flatnonzero(short)
    order = order[np.argsort(-length[order], kind="stable")]
    at, size = start[order], length[order]
    inner = ~state[order]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))
        part = inner[:n]
        inner[:n] = CRC[(part ^ low[at[:n] + j]) & 0xFF] ^ part >> 8
    out[order] = ~inner
    return out


def _count_batch(batch: pa.RecordBatch, counts: dict[bytes, int], least: int, noise: int) -> None:
    prefix = [zlib.crc32(b"%d:" % i if i is not None else b":") for i in batch["doc_id"].to_pylist()]
    prefix = np.array(prefix, np.uint32)
    for row, offsets, data in pieces(batch["text"]):
        low = LOWER[data]
        start, length, text = _letter_runs(low, offsets)
        points = _points(low, start, length)
        long_ = points >= least
        start, length, text, points = start[long_], length[long_], text[long_], points[long_]
        h = _checksums(low, start, length, prefix[row + text])
        noisy = h % noise == 0
        for k in np.flatnonzero(noisy):
            word = low[start[k] : start[k] + length[k]].tobytes().decode()
            at = int(h[k]) % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) >= least:
                word = word.encode()
                counts[word] = counts.get(word, 0) + 1
        start, length = start[~noisy], length[~noisy]
        _, first, n = np.unique(span_ids(low, start, length), return_index=True, return_counts=True)
        for at, size, times in zip(start[first].tolist(), length[first].tolist(), n.tolist()):
            word = low[at : at + size].tobytes()
            counts[word] = counts.get(word, 0) + times


def vocabulary(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, noise: int = NOISE
) -> DataFrame:
    """word, n: the words of all texts that are long and frequent enough, written."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def taken() -> pa.RecordBatch:
            words = pa.array(counts.keys(), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            _count_batch(batch, counts, least_length, noise)
            if len(counts) > HELD:
                yield taken()
                counts.clear()
        yield taken()

    prepare(docs.sparkSession)
    found = texts(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(found.filter(F.col("n") >= least_count))


def _codes(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of letter numbers."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length)
    return np.where(points < 0x80, points - 0x61, points - 0xC0 + 26).astype(np.int64)


def _marks(places: np.ndarray) -> np.ndarray:
    """A random number for every letter at every place; places down."""
    cell = (places[:, None] * _SIZE + np.arange(_SIZE)).astype(np.uint64) + np.uint64(1)
    return mix(cell * np.uint64(0x9E3779B97F4A7C15))


def _keys(codes: np.ndarray) -> np.ndarray:
    """Sum of the marks of a word's letters: what an edit changes in it is known without the rest of the word."""
    total = np.zeros(len(codes), np.uint64)
    for i in range(codes.shape[1]):
        total += _marks(np.array([i]))[0][codes[:, i]]
    return total


#: Four of 64 bits for each value of twelve bits.
_PATTERNS = np.bitwise_or.reduce(
    np.uint64(1) << (mix(np.arange(1, (1 << 12) + 1, dtype=np.uint64))[:, None] >> np.arange(0, 24, 6, dtype=np.uint64) & np.uint64(63)),
    axis=1,
)


def _cells(keys: np.ndarray, base: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bits of each key in the filter that starts at `base`."""
    scrambled = mix(keys.copy())
    place = (scrambled >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    return place.astype(np.int64) + base, _PATTERNS[(scrambled & np.uint64(0xFFF)).astype(np.int64)]


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        out.setdefault(len(word), []).append(k)
    return out


def _filters(words: DataFrame, shards: dict[int, tuple[int, int]]) -> DataFrame:
    """block, bits: the filters of all lengths as one row of blocks, written."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch["word"].to_pylist()
            for length, rows in _by_length(listed).items():
                block, bits = _cells(_keys(_codes([listed[k] for k in rows], length)), *shards[length])
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(bits.view(np.int64))], ["block", "bits"])

    cells = words.select("word").mapInArrow(place, "block long, bits long")
    return materialize(cells.groupBy("block").agg(F.bit_or("bits").alias("bits")))


def _deletions(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place, rows, keys of the words without one letter; of equal neighbours only the first is taken away."""
    length = codes.shape[1]
    marks = [_marks(np.array([i]))[0] for i in range(length)]
    # The letters behind the gap, one place further to the front.
    tail = np.zeros(len(codes), np.uint64)
    for i in range(1, length):
        tail += marks[i - 1][codes[:, i]]
    head = np.zeros(len(codes), np.uint64)
    for i in range(length):
        rows = np.flatnonzero(codes[:, i] != codes[:, i - 1]) if i else np.arange(len(codes))
        yield i, rows, (head + tail)[rows]
        head += marks[i][codes[:, i]]
        if i + 1 < length:
            tail -= marks[i][codes[:, i + 1]]


def _replacements(codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Place, letter, rows, keys of the words with one letter replaced by a later one."""
    keys = _keys(codes)
    for i in range(codes.shape[1]):
        marks = _marks(np.array([i]))[0]
        order = np.argsort(codes[:, i], kind="stable")
        sorted_codes = codes[order, i]
        rest = keys[order] - marks[sorted_codes]
        for letter in range(1, _SIZE):
            n = int(np.searchsorted(sorted_codes, letter))
            if n:
                yield i, letter, order[:n], rest[:n] + marks[letter]


def _probe_task(shards: dict[int, tuple[int, int]], held, low: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = [], []
        for batch in batches:
            words += batch["word"].to_pylist()
            counts += batch["n"].to_pylist()
            if len(words) >= PROBED:
                yield from _probe(words, counts, shards, held.value, low)
                words, counts = [], []
        if words:
            yield from _probe(words, counts, shards, held.value, low)

    return run


def _probe(words: list[str], counts: list[int], shards, table: np.ndarray, low: int) -> Iterator[pa.RecordBatch]:
    """word, n, edit: generated edits that a filter holds, as far as this round's blocks go."""
    high = low + len(table)

    def covered(length: int) -> bool:
        base, blocks = shards.get(length, (0, 0))
        return base < high and base + blocks > low

    def hits(keys: np.ndarray, length: int) -> np.ndarray:
        block, bits = _cells(keys, *shards[length])
        here = np.flatnonzero((block >= low) & (block < high))
        bits = bits[here]
        return here[(table[block[here] - low] & bits) == bits]

    def batch(rows: list[int], edits: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([words[k] for k in rows]), pa.array([counts[k] for k in rows], pa.int64()), pa.array(edits)],
            ["word", "n", "edit"],
        )

    for length, members in _by_length(words).items():
        codes = _codes([words[k] for k in members], length)
        rows, edits = [], []
        if covered(length - 1):
            for i, some, keys in _deletions(codes):
                for k in some[hits(keys, length - 1)].tolist():
                    word = words[members[k]]
                    rows.append(members[k])
                    edits.append(word[:i] + word[i + 1 :])
        if covered(length):
            for i, letter, some, keys in _replacements(codes):
                shown = chr(LETTERS[letter])
                for k in some[hits(keys, length)].tolist():
                    word = words[members[k]]
                    rows.append(members[k])
                    edits.append(word[:i] + shown + word[i + 1 :])
        if rows:
            yield batch(rows, edits)


def near_pairs(words: DataFrame, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """word, n, near, near_n: all pairs of words of a written vocabulary that are one edit apart, each once, written."""
    spark = words.sparkSession
    prepare(spark)
    sizes = words.groupBy(F.length("word").alias("length")).count().orderBy("length").collect()
    shards, end = {}, 0
    for r in sizes:
        blocks = -(-r["count"] * BITS // 64)
        shards[r.length] = end, blocks
        end += blocks
    table = _filters(words, shards)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = words.repartition(parts, "word")
    found = []
    for low in range(0, end, round_blocks):
        part = table.filter(F.col("block").between(low, low + round_blocks - 1)).toArrow()
        filled = np.zeros(min(round_blocks, end - low), np.uint64)
        filled[part["block"].to_numpy() - low] = part["bits"].to_numpy().view(np.uint64)
        held = spark.sparkContext.broadcast(filled)
        found.append(materialize(dealt.mapInArrow(_probe_task(shards, held, low), "word string, n long, edit string")))
    if not found:
        return spark.createDataFrame([], "word string, n long, near string, near_n long")
    positives = found[0]
    for more in found[1:]:
        positives = positives.unionByName(more)
    true = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = materialize(positives.withColumnRenamed("edit", "near").join(true, "near").select("word", "n", "near", "near_n"))
    for written in (table, *found):
        discard(written)
    return pairs


def variants(docs: DataFrame, **limits: int) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of the vocabulary and what it may be a misspelling of.

    A null or empty text has no words; a row without an id is counted as one with an empty id. Every row counts, also
    repeated ones. Of equally frequent near words the first in code-point order is the form. Texts of any length are
    read whole, in pieces. An empty table gives no rows; other columns are ignored. `limits` are those of `vocabulary`.
    """
    words = vocabulary(docs, **limits)
    pairs = near_pairs(words)
    # Both directions of each pair.
    here, there = ("word", "n"), ("near", "near_n")
    sides = F.array(
        *(F.struct(F.col(a).alias("word"), F.col(b).alias("near"), F.col(c).alias("near_n")) for a, b, c in ((*here[:1], *there), (there[0], *here)))
    )
    met = pairs.select(F.explode(sides).alias("s")).select("s.*")
    best = met.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first")
    )
    frequent = -F.col("first.less") >= RATIO * F.col("n")
    formed = materialize(
        words.join(best, "word", "left").select(
            "word",
            F.when(frequent, F.col("first.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(frequent, -F.col("first.less")).alias("form_n"),
        )
    )
    return formed.join(_roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(formed: DataFrame) -> DataFrame:
    """word, root of the words that have a form: each round doubles the steps; forms grow fivefold, so there are few."""
    steps = materialize(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = materialize(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if longer.filter("moved").isEmpty():
            return steps
        steps = longer.select("word", "root")
