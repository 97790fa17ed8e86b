"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tomoloom.llm import spelling as sp

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(docs, least=6, times=5, noise=199):
    counts = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= times}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for a in words:
        best = min(near[a], key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 5 * words[a] else None
    out = set()
    for a in words:
        root = a
        while form[root] is not None:
            root = form[root]
        out.add((a, form[a], root, words[a], len(near[a]), words[form[a]] if form[a] else None))
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcé÷ÿz"
    words = ["".join(rng.choices(letters, k=rng.randrange(5, 10))) for _ in range(60)]
    for _ in range(120):
        word = rng.choice(words)
        i, c = rng.randrange(len(word)), rng.choice(letters)
        words.append(rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]]))
    chosen = rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=9000)
    return [(i, rng.choice([" ", ". ", "1", "\n", "ſ"]).join(chosen[i * 30 : i * 30 + 30])) for i in range(300)]


def test_equals_plain_comparison(spark):
    docs = corpus(4) + [(3, "Capital CAPITAL capital capitaL Capitak capital")] * 4
    # A form that has a form.
    docs += [(800, "chainword " * 260), (801, "chainwort " * 45), (802, "chainwart " * 7)]
    docs += [(None, "capital capitals"), (None, None), (700, ""), (701, "x" * 3000), (702, "longer " * 60000)] + [(703, "y" * 60 + " ")] * 9
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, word int").repartition(3)
    got = {tuple(r) for r in sp.variants(table).collect()}
    expected = plain(plain_words(docs))
    assert got == expected
    assert any(form and root != form for _, form, root, *_ in expected), "no chain of forms in the fixture"


@pytest.mark.parametrize("blocks", [1, 7, 1 << 20])
def test_rounds_find_the_same_pairs(spark, blocks):
    words = plain_words(corpus(9), noise=10**9)
    listed = sorted(words, key=lambda w: -words[w])[:40]
    table = sp.materialize(spark.createDataFrame([(w, words[w]) for w in listed], "word string, n long"))
    rows = sp.near_pairs(table, round_blocks=blocks).collect()
    got = {frozenset((r.word, r.near)) for r in rows}
    assert got == {frozenset((a, b)) for a in listed for b in listed if one_edit(a, b)} and len(got) == len(rows)


def test_keys_of_edits():
    words = ["aabbcc", "éàzzya", "zzzzzz"]
    codes = sp._codes(words, 6)
    for i, rows, keys in sp._deletions(codes):
        for k, key in zip(rows, keys):
            shorter = words[k][:i] + words[k][i + 1 :]
            assert sp._keys(sp._codes([shorter], 5))[0] == key
    for i, letter, rows, keys in sp._replacements(codes):
        for k, key in zip(rows, keys):
            other = words[k][:i] + chr(sp.LETTERS[letter]) + words[k][i + 1 :]
            assert sp._keys(sp._codes([other], 6))[0] == key


def test_filters_hold_all_and_little_else():
    rng = np.random.default_rng(1)
    keys, others = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 1 << 63, 50000, dtype=np.uint64)
    blocks = -(-len(keys) * sp.BITS // 64)
    table = np.zeros(blocks, np.uint64)
    at, bits = sp._cells(keys, 0, blocks)
    np.bitwise_or.at(table, at, bits)
    assert ((table[at] & bits) == bits).all()
    at, bits = sp._cells(others, 0, blocks)
    assert ((table[at] & bits) == bits).mean() < 0.02


def test_empty_table(spark):
    assert sp.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
