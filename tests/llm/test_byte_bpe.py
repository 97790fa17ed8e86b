"""Chunked encoding against the library on whole texts; decoding gives the bytes back."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tomoloom.llm import byte_bpe

NAME = "byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path(NAME), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(reference, text):
    ids = np.array(reference.encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


TEXTS = [
    None,
    "",
    " ",
    "\n\n  \t",
    "it's a   test\n\n of 123 things!?  ",
    "a" * 700,
    " " * 500 + "end",
    "\n" * 300 + "x" + "\n" * 300,
    "word, " * 200,
    "é漢字🙂 " * 90,
    "don't  stop\r\n\r\n" * 60,
    "1234567890" * 50 + " \n " + "%%% *** " * 40,
    "<|endoftext|> " * 40,
]


@pytest.mark.parametrize("chunk,overlap", [(64, 24), (50, 8), (32768, 2048)])
def test_same_ids_as_whole_text(spark, reference, chunk, overlap):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "y"), (None, "alone " * 60, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted((tuple(r) for r in byte_bpe.round_trip(docs, NAME, chunk, overlap).collect()), key=str)
    assert got == sorted(((i, *expected(reference, t)) for i, t, _ in rows), key=str)


def test_whole_table(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in byte_bpe.round_trip(docs, NAME, 1500, 100).collect()}
    assert got == {r.doc_id: expected(reference, r.text) for r in docs.collect()}


@pytest.mark.parametrize("step,overlap", [(40, 9), (64, 24), (2048, 256)])
def test_pieces_of_one_text(reference, step, overlap):
    for text in TEXTS + ["x" * 5000 + " and then on " * 400, " " * 6000 + "a b c " * 900]:
        assert "".join(byte_bpe.pieces(text or "", step, overlap)) == (text or "")
        ids = np.frombuffer(byte_bpe.encode(text or "", NAME, step, overlap), "<u4")
        assert ids.tolist() == reference.encode_ordinary(text or "")


def test_long_texts_are_stitched(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    long = [r.text for r in docs.collect() if len(r.text) > byte_bpe.SMALL_CHARS + byte_bpe.SMALL_OVERLAP]
    cut = [len(byte_bpe.pieces(t, byte_bpe.SMALL_CHARS, byte_bpe.SMALL_OVERLAP)) for t in long]
    assert len(long) > 200 and min(cut) > 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string").filter(F.lit(True))
    assert byte_bpe.round_trip(docs).count() == 0
