"""Suffix arrays, common prefixes and removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomoloom.llm import suffix_dedup as dedup
from tomoloom.llm.suffix_dedup import LENGTH


def brute(texts):
    """n_bytes, n_removed, n_spans and digest of what is left of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + LENGTH] for t in raw for i in range(len(t) - LENGTH + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - LENGTH + 1):
            if seen[t[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def run(docs):
    kept = F.when(F.col("kept").isNull(), F.col("sha256")).otherwise(F.sha2("kept", 256))
    found = dedup.without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", kept)
    return sorted((tuple(r) for r in found.collect()), key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ref string").repartition(3)
    expected = [(i, *figures) for (i, _), figures in zip(rows, brute([t for _, t in rows]))]
    assert run(docs) == sorted(expected, key=str)


def word(rng, size=6):
    return "".join(rng.choice("abcdefgh") for _ in range(size))


def prose(rng, words):
    return " ".join(word(rng) for _ in range(words))


def test_suffix_array_and_prefixes():
    rng = random.Random(5)
    for trial in range(40):
        n, letters = rng.randrange(1, 300), rng.choice([1, 2, 4, 200])
        raw = bytes(rng.randrange(letters) for _ in range(n))
        if trial % 3 == 0:
            raw = (raw[:7] * 80)[:n]
        data = np.frombuffer(raw, np.uint8)
        order = dedup.suffix_array(data)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        starts = np.array(sorted({0, *(rng.randrange(n) for _ in range(3))}))
        shared = dedup.common_prefixes(data, order, starts, 50)
        for r in range(1, n):
            a, b = raw[order[r - 1] :], raw[order[r] :]
            k = 0
            while k < min(50, len(a), len(b)) and a[k] == b[k]:
                k += 1
            assert shared[r] == k


CASES = {
    "edges": lambda r, p: [(1, None), (2, ""), (3, "a" * 199), (4, "a" * 200), (5, "b" * 201), (6, "ab" * 300), (7, p[:200]), (8, "z" + p[:200]), (9, p[:199] + "!")],
    "overlap": lambda r, p: [(1, p[:900]), (2, p[300:700] + "zz" + p[500:1200]), (3, "q" + p[100:301] + "é漢" * 90), (4, "é漢" * 90)],
    "copies": lambda r, p: [(i, p[:1500]) for i in range(30)] + [(40 + i, p[: 700 + i] + prose(r, 40)) for i in range(30)],
    "repeated ids": lambda r, p: [(1, p[:500]), (1, p[:500]), (1, p[600:900]), (None, p[200:450]), (None, None)],
}


@pytest.mark.parametrize("case", CASES)
def test_cases(spark, case):
    rng = random.Random(11)
    check(spark, CASES[case](rng, prose(rng, 300)))


def test_split_anchors_and_parts(spark, monkeypatch):
    """Shards of three pieces, parts of 700 bytes: everything is split and merged."""
    monkeypatch.setattr(dedup, "SHARD_PIECES", 3)
    monkeypatch.setattr(dedup, "PART_BYTES", 700)
    rng = random.Random(2)
    shared = prose(rng, 60)
    rows = [(i, prose(rng, rng.randrange(30)) + shared[: rng.randrange(150, 420)] + rng.choice("abc") + prose(rng, 9)) for i in range(80)]
    check(spark, rows + [(100, shared * 3)])


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = [(i, *figures) for (i, _), figures in zip(rows, brute([t for _, t in rows]))]
    assert run(docs) == sorted(expected, key=str)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []
