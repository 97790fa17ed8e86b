"""The pipeline's stages, each judged on its own input against a brute-force version."""

import hashlib
import random

import pytest

import corpus_pipeline
from tomoloom.llm import byte_bpe

import test_byte_bpe
import test_decontaminate
import test_jaccard_join

FOLDER = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies, toxic words and benchmark passages, and extra columns."""
    rng = random.Random(6)
    path = tmp_path_factory.mktemp("tables")
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    bench = [(i, prose(20)) for i in range(6)]
    texts = [prose(rng.randrange(20, 60)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i]) for i in range(5)] + [(110 + i, texts[10 + i] + " more") for i in range(5)]
    rows += [(120 + i, prose(15) + " " + bench[i][1] + " " + prose(9)) for i in range(4)]
    rows += [(200 + i, prose(20) + " idiot scum " + prose(9)) for i in range(30)] + [(300, None), (301, ""), (302, " \n")]
    labels = [(i, 1, int(200 <= i < 300)) for i, _ in rows]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)

def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    bench = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, folder)
        found.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if number < 4:
            assert docs.columns == columns
            left = {r.doc_id: r.text for r in docs.collect()}
            assert all(rows[i] == t for i, t in left.items())
        if number == 0:
            expected = {i for i in rows if not 200 <= i < 300}
        elif number == 1:
            best = {}
            for i, t in rows.items():
                best[t or ""] = max(best.get(t or "", i), i)
            expected = set(best.values())
        elif number == 2:
            expected = {c for _, _, c in test_jaccard_join.brute(sorted(rows.items()))}
        elif number == 3:
            expected = {i for i, t in rows.items() if not any(test_decontaminate.brute(t, b) for b in bench)}
        if number < 4:
            assert set(left) == expected, number
            rows = left
    for r in docs.collect():
        ids = byte_bpe.encode(rows[r.doc_id] or "", test_byte_bpe.NAME)
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest()
    assert docs.count() == len(rows) and {120, 121, 122, 123}.isdisjoint(rows)

def test_run_on_a_whole_table(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < found.count() < 200

def test_names_match_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    assert corpus_pipeline.ORACLE_SQL is None
