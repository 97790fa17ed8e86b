"""Held-out accuracy of the two classifiers, and their defined results on odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomoloom.llm import quality_cnn, toxicity

FOLDER = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (None, "plain words"), (4, "x" * 40000), (4, "x" * 40000)]


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").join(labels, "doc_id").filter(F.col("doc_id") % 3 != 0)
    return docs.select("doc_id", "text", "quality", "toxic", F.lit(9).alias("score")), labels


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    scored = quality_cnn.quality_scores(docs, labels, rows=1200)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(labels, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    held = rows[rows.held_out]
    low, high = held[held.quality == 0].score, held[held.quality == 1].score
    assert len(low) > 100
    assert (held.predicted == held.quality).mean() > 0.95
    assert (high.to_numpy()[:, None] > low.to_numpy()).mean() > 0.99


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    rows = toxicity.toxicity_scores(docs, labels, rows=3000).join(labels.withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert held[held.label == 1].toxic.mean() > 0.8
    assert held[held.label == 0].toxic.mean() < 0.01


def test_odd_rows(spark, tables):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, probability string").repartition(2)
    none = tables[1].filter("false")
    scored = quality_cnn.quality_scores(docs, none).collect()
    assert len(scored) == len(ODD) and {r.score for r in scored} == {0.5}
    net = quality_cnn.new_network()
    by_id = {r.doc_id: r.score for r in quality_cnn.score(docs, net).collect()}
    assert by_id[1] == by_id[2] and all(0 <= s <= 1 for s in by_id.values())
    kept = toxicity.drop_toxic(docs.withColumn("_p", F.lit(1)), none)
    assert "_p" in kept.columns
    assert quality_cnn.score(docs.filter("false"), net).count() == 0
    assert toxicity.toxicity_scores(docs.filter("false"), none).count() == 0


def test_chunks_cover_whole_texts():
    for size in (0, 1, 511, 512, 513, 960, 961, 5000):
        start, doc = quality_cnn.cut(np.array([0, size]))
        seen = np.zeros(size, bool)
        for s in start:
            seen[s : s + quality_cnn.CHUNK] = True
        assert seen.all() and len(doc) >= 1


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = quality_cnn.new_network(1)
    texts = [bytes(rng.integers(97, 105, n).astype(np.uint8)) for n in (30, 700, 1500)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    label = np.array([1, 0, 1], np.float32)

    def loss():
        p = quality_cnn.probabilities(net, data, offsets)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for part, slope in zip(net.parts(), quality_cnn._gradients(net, data, offsets, label)):
        flat = np.argsort(-np.abs(slope).ravel())[:3]
        for at in flat:
            at = np.unravel_index(at, part.shape)
            kept, step = part[at], 1e-3
            part[at] = kept + step
            up = loss()
            part[at] = kept - step
            down = loss()
            part[at] = kept
            assert abs((up - down) / (2 * step) - slope[at]) < 0.05 * abs(slope[at]) + 1e-3


def test_chain_uses_earlier_categories():
    docs = [b"you idiot", b"total trash", b"nice day", b"good words"] * 20
    chain = toxicity.train(docs, np.array([1, 1, 0, 0] * 20, float))
    sizes = [len(w) - len(chain.vocabulary) - 1 for w in chain.weights]
    assert sizes == [0, 1, 2, 3] and chain.weights[-1][-2] != 0
