"""Search against a plain ranking of all documents; postings that come back; blocks that stay compressed."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tomoloom.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def plain(docs, items, top=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [d for d in held if d[2]]
    n_docs, n_terms = len(held), sum(d[2] for d in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, count, n in held:
            m, score = 10 + 90 * n * n_docs // n_terms, 0
            for t in set(terms(text)):
                if count[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * count[t] // (1000 * count[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top], 1)]
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    names = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["É9", "ñ", "漢字", "UPPER", "a_b", "x-y"]
    return [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(names, k=rng.randrange(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("shard", [300, 4000, 1 << 20])
def test_equals_plain_ranking(spark, shard):
    docs = corpus(1, 400)
    # Equal scores, repeated rows and ids, rows without id, text or term, a very long text.
    docs += [(i, docs[5][1]) for i in range(900, 925)] + [(5, docs[5][1])] * 3 + [(None, docs[5][1])] * 2
    docs += [(1000, None), (1001, ""), (1002, " .,! "), (1003, "w1 w2 É9 " * 40000)]
    items = [(k, docs[k * 11][1]) for k in range(12)] + [(50, None), (51, "nowhere"), (52, docs[5][1]), (52, "w1 w1 upper"), (None, "漢字 ñ")]
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    index = ls.build_index(table, shard_bytes=shard)
    for pairs in (1 << 17, 20):
        got = [tuple(r) for r in ls.search_index(index, asked, pairs_per_job=pairs).collect()]
        assert sorted(got, key=repr) == sorted(plain(docs, items), key=repr)


def test_fewer_documents_than_asked(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "two"), (3, "two three")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "Two THREE")], "item_id long, text string")
    got = sorted(tuple(r) for r in ls.ranked(docs, items).collect())
    assert got == sorted(plain([(1, "one two"), (2, "two"), (3, "two three")], [(9, "Two THREE")]))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one")], "id long, text string")
    assert ls.ranked(docs, some.withColumnRenamed("id", "item_id")).count() == 0
    assert ls.ranked(some.withColumnRenamed("id", "doc_id"), items).count() == 0


def one_shard(term, doc, tf, lengths):
    rows = [r for b in ls.Postings(term, doc, tf, lengths).rows(0) for r in b.to_pylist()]
    return {r["term"]: r for r in rows}


def test_postings_come_back():
    rng = np.random.default_rng(3)
    term, doc = np.divmod(np.unique(rng.integers(0, 5 * 70000, 9000)), 70000)
    tf = rng.choice([1, 2, 300, 70000], len(term))
    lengths = rng.integers(1, 1000, 70000)
    for t, row in one_shard(term, doc, tf, lengths).items():
        x = ls.List(row, lengths, 70000, int(lengths.sum()))
        found, impact = x.blocks(range(len(x.last)))
        assert (found == doc[term == t]).all()
        assert (impact == ls._impact(tf[term == t], lengths[doc[term == t]], 70000, int(lengths.sum()))).all()
        for k in range(len(x.last)):
            assert x.block(k)[1].max() <= x.bounds[k]


def test_blocks_stay_compressed():
    # A rare term decides; of the common one only the blocks beside its documents are wanted once the heap is full.
    n = 20000
    lengths = np.full(n, 50)
    rare = np.concatenate([np.arange(0, 40), [9000]])
    term = np.concatenate([np.zeros(n, np.int64), np.ones(len(rare), np.int64)])
    doc = np.concatenate([np.arange(n), rare])
    tf = np.concatenate([np.ones(n, np.int64), np.where(rare == 9000, 9, 1)])
    rows = one_shard(term, doc, tf, lengths)
    lists = {t: ls.List(r, lengths, n, n * 50) for t, r in rows.items()}
    weights = {0: 5, 1: 6000}
    chosen = sorted(((t, w, w * lists[t].bound) for t, w in weights.items()), key=lambda x: -x[2])
    searcher = ls.Searcher({(0, 0): chosen}, n, n * 50, 10)
    searcher.shard(list(range(n)), lengths, rows)
    opened = searcher.opened
    searcher.shard(list(range(n, 2 * n)), lengths, rows)
    assert opened == searcher.held // 2 and searcher.opened - opened <= 3
    best = [d for _, d in searcher.heaps[0, 0]]
    assert best[:2] == [9000, 29000] and best[2:] == list(range(8))
