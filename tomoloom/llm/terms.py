"""Runs of bytes in whole texts: texts in bounded pieces, and the maximal runs inside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tomoloom.llm.common import BLOCK_BYTES, text_blocks

_byte = np.arange(256)
IS_ALNUM = (_byte < 128) & np.array([chr(b).isalnum() for b in range(256)])
#: ASCII bytes that are no letter or digit: no run of letters, digits or other characters goes on over one.
IS_CUT = (_byte < 128) & ~IS_ALNUM


def _cut_after(data: np.ndarray, at: int, window: int = 1 << 16) -> int:
    """The first place from `at` on where a run cannot go on, or the end."""
    while at < len(data):
        found = IS_CUT[data[at : at + window]]
        if found.any():
            return at + int(found.argmax())
        at += window
    return len(data)


def pieces(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts of a batch as pieces of about `limit` bytes: the first row, offsets from 0, and the bytes.

    A piece holds several whole texts, or a part of one longer text that ends where no run goes on. Only a run that is
    itself longer makes a piece longer.
    """
    for row, offsets, data in text_blocks(column, limit):
        if len(offsets) > 2 or len(data) <= limit:
            yield row, offsets, data
            continue
        at = 0
        while at < len(data):
            stop = _cut_after(data, min(at + limit, len(data)))
            yield row, np.array([0, stop - at]), data[at:stop]
            at = stop


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text index of the maximal runs of true bytes; no run crosses from one text into the next."""
    if not len(inside):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1 - start, np.searchsorted(offsets, start, "right") - 1
