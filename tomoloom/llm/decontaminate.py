"""Benchmark decontamination by the q-gram lemma.

A text holds a benchmark item if any WINDOW bytes in a row of it, wherever they start, occur in the text with few edits;
a shorter item must occur as a whole. A passage of m bytes that occurs with at most e edits shares m - q + 1 - q * e of
its q-grams with the text, all of them on diagonals (text position less item position) that lie e around one another.
Items are cut into pieces of two windows that overlap by one, so every passage lies in a piece. Shared q-grams are counted
per piece in overlapping diagonal bands; in bands that reach a passage's bound, passages are verified by an alignment
confined to the band. Texts are scanned in one Arrow pass without a shuffle; the benchmark travels to the tasks in blocks
of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoloom.llm.common import IS_SPACE, LOWER, eight_bytes, prepare, text_blocks, texts

Q = 8  # a q-gram is one 64-bit number
#: Bytes of the smallest passage that counts (about 13 words). An item under MIN_ITEM holds no q-gram.
WINDOW, MIN_ITEM = 80, Q
#: Passages are verified at every STEP-th start first.
STEP = 40
EDIT_SHARE = 0.1
#: Bytes of benchmark text in one block, and so in one broadcast.
BLOCK_BYTES = 4 << 20
#: Pairs of a text and a window position looked at together.
PAIRS_AT_ONCE = 1 << 21
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
NORMAL = np.where(IS_SPACE, 32, LOWER).astype(np.uint8)


@dataclass
class Index:
    """Pieces of one block of items and the places of their q-grams."""

    item: np.ndarray  # item's number, per piece
    start: np.ndarray  # of the piece in `data`
    length: np.ndarray
    run: np.ndarray  # bytes of a passage in the piece
    budget: np.ndarray  # edits of a passage
    data: np.ndarray
    grams: np.ndarray  # sorted distinct q-grams
    first: np.ndarray  # of each q-gram in the two lists below, and the end
    window: np.ndarray
    offset: np.ndarray
    likely: np.ndarray  # by the top bits of the spread q-gram


def edit_budget(length: np.ndarray, share: float = EDIT_SHARE) -> np.ndarray:
    """Edits allowed, as many as leave the lemma a bound of one q-gram or more."""
    return np.minimum((length * share).astype(np.int64), (length - Q) // Q)


def build_index(items: list[str], share: float = EDIT_SHARE, min_item: int = MIN_ITEM) -> Index:
    """Items shorter than `min_item` bytes are no evidence and have no piece."""
    item, start, length, data = [], [], [], bytearray()
    for number, text in enumerate(items):
        raw = NORMAL[np.frombuffer((text or "").strip().encode(), np.uint8)].tobytes()
        if len(raw) < min_item:
            continue
        for at in range(0, max(1, len(raw) - WINDOW), WINDOW):
            item.append(number)
            start.append(len(data) + at)
            length.append(min(2 * WINDOW, len(raw) - at))
        data += raw
    item, start, length = (np.array(x, np.int64) for x in (item, start, length))
    data = np.frombuffer(bytes(data), np.uint8)
    count = length - Q + 1
    window = np.repeat(np.arange(len(item)), count)
    offset = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
    gram = eight_bytes(data)[start[window] + offset] if len(window) else np.zeros(0, np.uint64)
    order = np.argsort(gram, kind="stable")
    grams, first = np.unique(gram[order], return_index=True)
    likely = np.zeros(1 << 20, bool)
    likely[grams * _SPREAD >> np.uint64(44)] = True
    run = np.minimum(length, WINDOW)
    return Index(
        item, start, length, run, edit_budget(run, share), data, grams, np.append(first, len(gram)), window[order], offset[order], likely
    )


def _bands(index: Index, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of document, piece and band that reach the bound of the piece's passages."""
    # A q-gram that runs into the next text meets a zero byte only at the very end, so its start is checked.
    gram = eight_bytes(data)
    at = np.flatnonzero(index.likely[gram * _SPREAD >> np.uint64(44)])
    found = np.minimum(np.searchsorted(index.grams, gram[at]), len(index.grams) - 1)
    known = index.grams[found] == gram[at]
    at, found = at[known], found[known]
    doc = np.searchsorted(offsets, at, "right") - 1
    inside = at + Q <= offsets[doc + 1]
    at, found, doc = at[inside], found[inside], doc[inside]
    count = index.first[found + 1] - index.first[found]
    width = 2 * index.budget + 1
    keys, totals, low = [], [], 0
    ends = np.cumsum(count)
    # One number per document, piece and band; a band starts at most a piece before the first text.
    floor, bands, docs = -2 * WINDOW - 2, len(data) + 2 * WINDOW + 4, len(offsets) - 1
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS_AT_ONCE, "right")))
        part = slice(low, high)
        n = count[part]
        place = np.repeat(index.first[found[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        window = index.window[place]
        band = (np.repeat(at[part], n) - index.offset[place]) // width[window]
        # Bands span two widths and start at each width, so any run of diagonals of one width lies in one.
        key = (window * docs + np.repeat(doc[part], n)) * bands + (band - floor)
        key = np.sort(np.concatenate([key, key - 1]))
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        keys.append(key[new])
        totals.append(np.diff(np.append(new, len(key))))
        low = high
    if not keys:
        return np.zeros((3, 0), np.int64)
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True) if len(keys) > 1 else (keys[0], None)
    total = totals[0] if inverse is None else np.bincount(inverse, np.concatenate(totals))
    bound = index.run - Q + 1 - Q * index.budget
    key = key[total >= bound[key // bands // docs]]
    return np.stack([key // bands % docs, key // bands // docs, key % bands + floor])


def _distances(index: Index, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Least number of edits that turn a passage into a part of the text, on the band's diagonals.

    rows: document, piece, band and the passage's place in the piece.
    """
    doc, window, band, place = rows
    budget, length = index.budget[window], index.run[window]
    lowest = band * (2 * budget + 1) - budget + place
    most, span = int(length.max()), int(6 * budget.max() + 2)
    steps = np.arange(span, dtype=np.int16)
    beyond = steps[None] >= (6 * budget + 2)[:, None]
    far = np.int16(1 << 12)
    at = lowest[:, None] + np.arange(most + span)
    inside = (at >= offsets[doc][:, None]) & (at < offsets[doc + 1][:, None])
    text = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0)
    letters = index.data[np.minimum((index.start[window] + place)[:, None] + np.arange(most), len(index.data) - 1)]
    cost = np.where(beyond, far, np.int16(0))
    out = np.full(len(doc), int(far))
    for i in range(most):
        through = cost + (text[:, i : i + span] != letters[:, i, None])
        np.minimum(through[:, :-1], cost[:, 1:] + np.int16(1), out=through[:, :-1])
        through[beyond] = far
        cost = np.minimum.accumulate(through - steps, axis=1) + steps
        done = length == i + 1
        if done.any():
            out[done] = cost[done].min(1)
    return out


def _passages(rows: np.ndarray, first: np.ndarray, last: np.ndarray, step: int) -> np.ndarray:
    """Rows with every `step`-th passage from `first` to `last`, and the last one."""
    count = -(-(last - first) // step) + 1
    at = np.repeat(np.arange(len(count)), count)
    place = np.minimum(first[at] + step * (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)), last[at])
    return np.vstack([rows[:3, at], place])


def _verified(index: Index, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and item of the passages within their budget, and the distances of all."""
    far = [_distances(index, data, offsets, rows[:, low : low + 2048]) for low in range(0, rows.shape[1], 2048)]
    far = np.concatenate(far) if far else np.zeros(0, np.int64)
    good = rows[:, far <= index.budget[rows[1]]]
    return np.stack([good[0], index.item[good[1]]]), far


def matches(index: Index, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and item of each verified pair."""
    data = NORMAL[data]
    if not len(index.grams) or not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, pairs = _bands(index, data, offsets), []
    items = int(index.item.max()) + 1
    for low in range(0, rows.shape[1], 4096):
        part = rows[:, low : low + 4096]
        coarse = _passages(part, np.zeros_like(part[1]), (index.length - index.run)[part[1]], STEP)
        good, far = _verified(index, data, offsets, coarse)
        pairs.append(good)
        # A passage k bytes further on is at most k edits nearer, so only the surroundings of near ones are left.
        near = far <= index.budget[coarse[1]] + STEP // 2
        near &= ~np.isin(coarse[0] * items + index.item[coarse[1]], good[0] * items + good[1])
        around, last = coarse[:, near], (index.length - index.run)[coarse[1, near]]
        fine = _passages(around, np.maximum(around[3] - STEP // 2, 0), np.minimum(around[3] + STEP // 2, last), 1)
        pairs.append(_verified(index, data, offsets, np.unique(fine, axis=1))[0])
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.unique(np.hstack(pairs), axis=1)
    return found[0], found[1]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, a block at a time."""
    items = benchmark.select("item_id", "text").filter(F.octet_length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // block_bytes)
    for k in range(count):
        # A block has about `block_bytes`; more blocks, not larger ones, hold a larger benchmark.
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").toPandas()
        yield [None if i != i or i is None else int(i) for i in part["item_id"]], part["text"].tolist()


def _found_in(held: Broadcast):
    """A column function: ids of one block's items found in each text."""

    @F.arrow_udf("array<bigint>")
    def part(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids, index = held.value
        for batch in column:
            lists: list[list] = [[] for _ in range(len(batch))]
            for row, offsets, data in text_blocks(batch):
                for doc, item in zip(*(x.tolist() for x in matches(index, data, offsets))):
                    lists[row + doc].append(ids[item])
            yield pa.array(lists, pa.list_(pa.int64()))

    return part


def items_column(benchmark: DataFrame, text: Column, share: float = EDIT_SHARE, block_bytes: int = BLOCK_BYTES) -> Column:
    """Sorted ids of the items of which a passage occurs in the text."""
    context = benchmark.sparkSession.sparkContext
    found = [
        _found_in(context.broadcast((ids, build_index(items, share))))(F.coalesce(text, F.lit("")))
        for ids, items in _blocks(benchmark, block_bytes)
    ]
    none = F.array().cast("array<bigint>")
    return F.array_sort(F.array_distinct(F.concat(*found) if found else none))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """One row per document: doc_id, items (sorted ids of benchmark items found in it), contaminated.

    Letters A-Z count as lower case and any white space as a space. An item is found if any 80 bytes in a row of
    it (all of it if it is shorter) occur with edits of at most `share` of their length. Items under 8 bytes, empty and
    null ones are no evidence; a null item_id is listed as null. Null and empty texts are clean. Repeated rows each give a row, an
    empty table none; other columns are ignored.
    """
    prepare(docs.sparkSession)
    found = texts(docs).select("doc_id", items_column(benchmark, F.col("text"), share).alias("items"))
    return found.withColumn("contaminated", F.size("items") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """`docs` without the contaminated ones, all columns kept, whatever their names.

    Null and empty texts stay; repeated rows, rows without an id and texts of any length are judged by their whole text.
    """
    prepare(docs.sparkSession)
    return docs.filter(F.size(items_column(benchmark, F.col("text"), share)) == 0)
