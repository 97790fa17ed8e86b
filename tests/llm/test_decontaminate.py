"""Windows found with edits, against alignment of every window with the whole text."""

import random

import numpy as np

from tomoloom.llm import decontaminate as d

LETTERS = "abcdefghij klmno"


def distance(part, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(part, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def budget(size):
    return min(int(size * d.EDIT_SHARE), (size - d.Q) // d.Q)


def brute(text, item):
    """Whether the text holds a passage of the item, at whichever byte the passage starts; a shorter item as a whole."""
    low, part = (" ".join(x.lower().split()) for x in (text or "", (item or "").strip()))
    if len(part) < d.MIN_ITEM:
        return False
    size = min(d.WINDOW, len(part))
    # A passage within the budget keeps one of its stretches of this length as it is, so others need no alignment.
    step = size // (budget(size) + 1)
    for at in range(len(part) - size + 1):
        passage = part[at : at + size]
        if any(passage[k : k + step] in low for k in range(0, size - step + 1, step)) and distance(passage, low) <= budget(size):
            return True
    return False


def line(rng, size):
    return "".join(rng.choice(LETTERS.replace(" ", "")) if i % 6 else " " for i in range(size)).strip()


def edit(rng, text, count):
    out = list(text)
    for _ in range(count):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "x"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "y")
    return "".join(out)


def cases(rng):
    items = [line(rng, n) for n in (30, 45, 60, 120, 160, 230, 400)]
    texts = [None, "", "short", line(rng, 900)]
    for item in items:
        for share in (0, 0.05, 0.09, 0.12, 0.2):
            body = edit(rng, item, int(len(item) * share))
            texts += [body, line(rng, 50) + " " + body.upper() + " " + line(rng, 70), body[: len(body) // 2] + line(rng, 40)]
    texts.append(items[5][:165] + line(rng, 30))
    return items, texts


def test_same_items(spark):
    items, texts = cases(random.Random(8))
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (None, items[3])], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, items int").repartition(3)
    for block in (1 << 20, 300):
        found = docs.select("doc_id", d.items_column(bench, docs.text, block_bytes=block).alias("i")).collect()
        for r in found:
            expected = {k for k, item in enumerate(items) if brute(texts[r.doc_id], item)} | ({None} if brute(texts[r.doc_id], items[3]) else set())
            assert set(r.i) == expected, r
    clean = d.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, t in enumerate(texts) if not any(brute(t, x) for x in items)]


def test_whole_benchmark_passages(spark):
    folder = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    passages = [(r.item_id, " ".join(r.text.lower().split())) for r in bench.collect()]
    body = {r.doc_id: " ".join(r.text.lower().split()) for r in docs.collect()}
    for r in d.contaminated(docs, bench).collect():
        assert {i for i, p in passages if p in body[r.doc_id]} <= set(r["items"])
        assert r.contaminated == bool(r["items"])


def test_texts_do_not_run_into_each_other():
    item = line(random.Random(1), 120)
    index = d.build_index([item])
    halves = [item[:60].encode(), item[60:].encode()]
    data = np.frombuffer(b"".join(halves), np.uint8)
    assert not len(d.matches(index, data, np.array([0, 60, len(data)]))[0])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "x" * 80)], "doc_id long, text string")
    assert [tuple(r) for r in d.contaminated(one, bench).collect()] == [(1, [], False)]
