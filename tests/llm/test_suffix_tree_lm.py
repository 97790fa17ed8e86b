"""Baseline against plain counts; the tree against a dictionary that looks for the longest kept suffix."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from tomoloom.llm import suffix_tree_lm as lm

SPACES = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"), " ")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.translate(SPACES).split(" ") if w]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def plain_tree(rows):
    """State (bytes) to counts of the next byte, for all contexts that the tree's definition keeps."""
    counts = [defaultdict(Counter) for _ in range(lm.DEPTH + 1)]
    total = 0
    for doc, text in rows:
        if held(doc):
            continue
        body = b"\n" * lm.DEPTH + b"".join(w.encode() + b" " for w in tokens(text)) + b"\n"
        for i in range(lm.DEPTH, len(body)):
            total += 1
            for d in range(lm.DEPTH + 1):
                counts[d][body[i - d : i]][body[i]] += 1
    least = max(lm.SHARE * total, lm.LEAST_COUNT)
    kept = {b""}
    for d in range(1, lm.DEPTH + 1):
        for context, n in counts[d].items():
            size, up = sum(n.values()), counts[d - 1][context[1:]]
            above = sum(up.values())
            gain = sum(k / size * math.log(k / size / (up[b] / above)) for b, k in n.items())
            if size >= least and gain >= lm.DIVERGENCE:
                kept |= {context[k:] for k in range(len(context))}
    return counts, kept


def plain_score(text, counts, kept):
    def chance(context, byte):
        n = counts[len(context)][context]
        size = sum(n.values())
        if not context:
            return (n[byte] + 1) / (size + 256)
        return (n[byte] + lm.PRIOR * chance(context[1:], byte)) / (size + lm.PRIOR)

    body = b"\n" * lm.DEPTH + b"".join(w.encode() + b" " for w in tokens(text)) + b"\n"
    total = 0.0
    for i in range(lm.DEPTH, len(body)):
        context = next(body[i - d : i] for d in range(lm.DEPTH, -1, -1) if body[i - d : i] in kept)
        total += math.log10(chance(context, body[i]))
    return total


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = sorted((tuple(r) for r in lm.text_scores(docs).collect()), key=lambda r: (str(r[0]), r[2]))
    words = Counter()
    for doc, text in rows:
        if not held(doc):
            words.update([*tokens(text), None])
    size, kinds = sum(words.values()), len(words)
    counts, kept = plain_tree(rows)
    expected = []
    for doc, text in rows:
        seq = [*tokens(text), None]
        base = sum(math.log10((words[t] + 1) / (size + kinds + 1)) for t in seq)
        expected.append((doc, held(doc), len(seq), sum(words[t] > 0 for t in seq), size, base, plain_score(text, counts, kept)))
    expected.sort(key=lambda r: (str(r[0]), r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for a, b in zip(got, expected):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 4000])


def test_odd_rows(spark):
    rows = [(i, "The the  cat\tsat on THE mat") for i in range(12)] + [(20, None), (21, ""), (22, " \n "), (None, "é 漢字 cat"), (5, "x" * 9000), (5, "the cat")]
    check(spark, rows)


def test_no_training_rows(spark):
    doc = next(i for i in range(100) if held(i))
    check(spark, [(doc, "a b")])


def test_empty_table(spark):
    assert lm.text_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
