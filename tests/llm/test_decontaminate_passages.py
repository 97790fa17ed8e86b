"""Parts of items in other prose, by a definition that names bytes of the item and no windows."""

import random

import numpy as np
from test_decontaminate import distance, edit, line

from tomoloom.llm import decontaminate as d


def found(items, texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    return set(zip(*(x.tolist() for x in d.matches(d.build_index(items), np.frombuffer(b"".join(raw), np.uint8), offsets))))


def nearest(item, text, size=80):
    return min(distance(item[at : at + size], text) for at in range(len(item) - size + 1))


def test_verbatim_middle_parts():
    rng = random.Random(3)
    items = [line(rng, n) for n in (119, 171, 233, 266, 390)]
    texts, expected = [], set()
    for k, item in enumerate(items):
        for size in (80, 83, 95):
            for at in (1, 7, 13, (len(item) - size) // 2, len(item) - size):
                expected.add((len(texts), k))
                texts.append(line(rng, 70) + item[at : at + size] + line(rng, 90))
    assert found(items, texts) == expected


def test_edited_parts_by_every_start():
    rng = random.Random(5)
    items = [line(rng, n) for n in (100, 163, 171)]
    texts = []
    for item in items:
        for edits in (4, 7, 8, 9, 10, 12):
            at = rng.randrange(len(item) - 84)
            texts.append(line(rng, 30) + edit(rng, item[at : at + 84], edits) + line(rng, 30))
    expected = {(i, k) for i, t in enumerate(texts) for k, item in enumerate(items) if nearest(item, t) <= 8}
    assert 0 < len(expected) < len(texts)
    assert found(items, texts) == expected


def test_short_items_are_searched_whole():
    rng = random.Random(7)
    items = [line(rng, n) for n in (12, 25, 39)]
    texts = [line(rng, 50) + item + line(rng, 50) for item in items] + [line(rng, 120)]
    assert found(items, texts) == {(0, 0), (1, 1), (2, 2)}
