"""Groups against a plain grouping in Python, over several runs and rounds."""

import hashlib
from collections import defaultdict

from tomoloom.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return sorted(
        (
            (d, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]),
             hashlib.sha256((t or "").encode()).hexdigest())
            for d, t in rows
        ),
        key=str,
    )


ROWS = [(i, f"text {i % 7}") for i in range(60)] + [(100, None), (101, ""), (None, ""), (102, " text 1"), (103, "Text 1"), (5, "text 5")]


def test_groups(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'a' as run", "1 as kept", "2 as best")
    for parts, fan_in in ((1, 8), (13, 2), (13, 8)):
        got = exact_dedup.exact_groups(docs.repartition(parts), fan_in).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(ROWS)
        kept = [r for r in got if r.kept]
        assert len(kept) == len({t or "" for _, t in ROWS})
        assert all(r.doc_id == r.keep_id for r in kept)


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    assert sum(r.kept for r in exact_dedup.exact_groups(docs.repartition(4)).collect()) == 2


def test_drop_copies_keeps_columns(spark):
    docs = spark.createDataFrame([(i, t, i * 2) for i, t in ROWS if i is not None], "doc_id long, text string, size long")
    out = exact_dedup.drop_copies(docs.repartition(5), 2)
    assert out.columns == docs.columns
    best = {}
    for i, t in ROWS:
        if i is not None:
            best[t or ""] = max(best.get(t or "", i), i)
    assert sorted((r.doc_id, r.size) for r in out.collect()) == sorted((i, i * 2) for i in best.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.drop_copies(docs).count() == 0
