"""Classes against all pairs in Python, with and without frequent tokens."""

import random

import numpy as np
import pytest

from tomoloom.llm import jaccard_join as join
from tomoloom.llm.components import components

SPACE = " \t\n\x0b\x0c\r"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(docs):
    return sorted((tuple(r) for r in join.shingle_components(docs).collect()), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice("uvwxyz") * 3
    return " ".join(words)


def corpus(rng):
    rows, number = [], 0
    for size in (1, 3, 5, 6, 8, 12, 30, 80, 200):
        base = [rng.choice("abcdefgh") + rng.choice("klmnop") for _ in range(size)]
        for k in range(10):
            rows.append((number, edited(rng, base, k // 2 if size > 4 else k % 2)))
            number += 1
    common = [f"line{i}" for i in range(40)]
    for k in range(25):
        own = [f"own{k}x{i}" for i in range(rng.randrange(16))]
        rows.append((number, " ".join(own + common[: rng.randrange(20, 41)])))
        number += 1
    return rows + [(number, None), (number + 1, ""), (number + 2, " \n"), (number + 3, "A  b\tc d E"), (number + 4, "a b c d e"), (number + 5, rows[75][1])]


@pytest.mark.parametrize("frequent", [False, True])
def test_same_classes(spark, monkeypatch, frequent):
    if frequent:
        monkeypatch.setattr(join, "ABOVE_MEAN", 0)
        monkeypatch.setattr(join, "AT_LEAST", 2)
        monkeypatch.setattr(join, "PART", 4)
    rows = corpus(random.Random(4))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, entry string").repartition(4)
    assert run(docs) == brute(rows)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "z y x w v u"), (None, "A b c d e f g"), (None, "q"), (2, None)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_near_copies_go(spark):
    rows = [(i, t, i) for i, t in corpus(random.Random(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    kept = join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    expected = {c for _, _, c in brute([(d, t) for d, t, _ in rows])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)


def test_entries_keep_the_bound():
    """Without shared entries of frequent pairs, two linked sets share `fewest` rare tokens, either's."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 1000, join.CELLS)
    for _ in range(300):
        size = int(rng.integers(1, 400))
        one = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        gone = int(rng.integers(0, join.spare(len(one)) + 1))
        other = np.unique(np.concatenate([one[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, gone + 1))).astype(np.uint64)]))
        if not join.linked(one, other):
            continue
        (a, pa), (b, pb) = (join.entries(s, counts, 100.0) for s in (one, other))
        pairs = np.intersect1d(a[pa > 0], b[pb > 0])
        rare = np.intersect1d(a[pa == 0], b[pb == 0])
        assert len(pairs) or len(rare) >= max(join.fewest(len(one)), join.fewest(len(other)))


def test_sizes_bound_shared_rare_tokens(spark):
    """Of linked sets that share no frequent pair, the rare tokens in common are `shared_least` at least."""
    rng, found = np.random.default_rng(5), []
    counts = rng.integers(0, 1000, join.CELLS)
    for _ in range(400):
        size = int(rng.integers(1, 400))
        one = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        gone = int(rng.integers(0, join.spare(len(one)) + 1))
        other = np.unique(np.concatenate([one[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, gone + 1))).astype(np.uint64)]))
        if join.linked(one, other):
            (a, pa), (b, pb) = (join.entries(s, counts, 100.0) for s in (one, other))
            if not len(np.intersect1d(a[pa > 0], b[pb > 0])):
                found.append((len(one), len(other), len(np.intersect1d(a[pa == 0], b[pb == 0]))))
    assert len(found) > 100
    least = spark.createDataFrame(found, "n_a int, n_b int, rare int").selectExpr(f"{join.shared_least('n_a', 'n_b')} as least", "rare", "n_a", "n_b")
    assert [r for r in least.collect() if r.rare < r.least] == []


def test_sets_far_from_links_are_no_pairs(spark):
    """Sets of 400 that share 40 rare entries each with all, where links of that size share 77; two share 100."""
    rows = [(e, -1, ref, 400, join.fewest(400), ref) for ref in range(12) for e in range(40)]
    rows += [(100 + e, -1, ref, 400, join.fewest(400), ref) for ref in (3, 7) for e in range(60)]
    members = spark.createDataFrame(rows, "entry long, part int, ref long, n int, need int, comp long")
    assert [tuple(r) for r in join._rest(members).collect()] == [(3, 7)]


def test_texts_around_one_passage_are_not_all_compared(spark, monkeypatch):
    """60 texts of 146 shingles, 116 of them from one passage: far from links, though all meet in frequent pairs."""
    monkeypatch.setattr(join, "ABOVE_MEAN", 0)
    monkeypatch.setattr(join, "AT_LEAST", 2)
    passage, compared = [f"w{i}" for i in range(150)], []
    texts = [passage[: 2 * k] + [f"own{k}x{i}" for i in range(26)] + passage[2 * k + 26 :] for k in range(60)]
    texts += [[*passage[:-1], f"last{k}"] for k in range(6)]
    plain = join._compared

    def counting(pairs, bodies):
        compared.append(pairs.count())
        return plain(pairs, bodies)

    monkeypatch.setattr(join, "_compared", counting)
    rows = [(k, " ".join(words)) for k, words in enumerate(texts)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)
    assert sum(compared) < 600


def test_rounds_keep_only_what_can_still_link(spark, monkeypatch):
    """Groups of near copies are one component after the first round: of their rows none is left for the second."""
    rng, rows, seen = random.Random(8), [], []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(60)]
        rows += [(10 * group + k, edited(rng, base, k // 4)) for k in range(8)]
    plain = join._leader_pairs

    def counting(members, turn):
        seen.append(members.count())
        return plain(members, turn)

    monkeypatch.setattr(join, "_leader_pairs", counting)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)
    assert seen[0] > 500 and max(seen[1:], default=0) < seen[0] / 10


def test_open_rows(spark):
    """Entry 1 lies in one component; 5 alone meets another one in too few rare entries, 6 and 7 in a frequent pair."""
    rows = [(1, -1, 1, 8, 2, 1), (1, -1, 2, 8, 2, 1), (2, -1, 1, 8, 2, 1), (2, -1, 3, 8, 2, 3), (3, -1, 1, 8, 2, 1), (3, -1, 3, 8, 2, 3)]
    rows += [(3, -1, 5, 8, 2, 5), (9, 0, 6, 8, 2, 6), (9, 0, 7, 8, 2, 7), (8, 0, 7, 8, 2, 7)]
    members = spark.createDataFrame(rows, "entry long, part int, ref long, n int, need int, comp long")
    kept = join._open(members)
    assert kept.columns == members.columns
    assert sorted((r.entry, r.ref) for r in kept.collect()) == [(2, 1), (2, 3), (3, 1), (3, 3), (9, 6), (9, 7)]


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(6)
    for size in (1, 40, 150, 3000):
        one = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        for gone in (0, size // 7, size):
            other = np.concatenate([one[gone:], rng.integers(0, 1 << 64, gone // 2, dtype=np.uint64)])
            bits = sum(int(b).bit_count() for b in (join.parity(one) ^ join.parity(other)).view(np.uint64))
            assert bits <= gone + gone // 2
            assert bits > 0 or gone == 0


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    found = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_empty_table(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []
