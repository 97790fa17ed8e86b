"""The pipeline's filters keep every column, also those named like the filters' own."""

import pytest

from tomoloom.llm import decontaminate, exact_dedup, jaccard_join, toxicity

FOLDER = "/root/testdata/sf0.001"
EXTRA = ("_dedup_row", "_toxic_p", "_bench_items", "_near_ref", "row", "best", "size", "ref", "run", "_DEDUP_ROW_")


def filters(spark):
    labels, bench = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("labels", "benchmark"))
    return {
        "toxic": lambda docs: toxicity.drop_toxic(docs, labels),
        "copies": exact_dedup.drop_copies,
        "near": jaccard_join.drop_near_copies,
        "benchmark": lambda docs: decontaminate.drop_contaminated(docs, bench),
    }


@pytest.mark.parametrize("name", ["toxic", "copies", "near", "benchmark"])
def test_clashing_columns(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    wide = docs.selectExpr("*", *(f"concat('{c}', doc_id) as `{c}`" for c in EXTRA))
    drop = filters(spark)[name]
    found = drop(wide)
    assert found.columns == wide.columns
    rows = found.collect()
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in EXTRA)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in drop(docs).collect())


@pytest.mark.parametrize("name", ["toxic", "copies", "near", "benchmark"])
def test_odd_rows(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    odd = [(None, None), (None, ""), (7, "five words of one text"), (7, "five words of one text"), (8, "w " * 60_000)]
    kept = filters(spark)[name](docs.limit(0).unionAll(spark.createDataFrame(odd, docs.schema)) if name != "toxic" else docs.unionAll(spark.createDataFrame(odd, docs.schema)))
    got = [tuple(r) for r in kept.filter("doc_id is null or doc_id in (7, 8)").collect() if tuple(r) in odd]
    if name == "copies":
        assert len([r for r in got if not r[1]]) == 1 and got.count(odd[2]) == 1
    elif name == "near":
        assert len([r for r in got if not r[1]]) == 2 and got.count(odd[2]) == 1
    else:
        assert sorted(got, key=repr) == sorted(odd, key=repr)
    assert odd[4] in got
