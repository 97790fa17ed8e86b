"""Packing, random access, and files that give back what the library encodes."""

import io
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tomoloom.llm import token_files as files

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def expected(library, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, out = 0, []
    for doc_id, text in ordered:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    packed = files.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert (files.unpack(packed, len(ids), bits) == ids).all()


def test_random_access():
    out = io.BytesIO()
    ids = np.random.default_rng(1).integers(0, 1 << 13, 20000).astype(np.uint32)
    writer = files.FileWriter(out, 13)
    cuts = [0, 1, 1, 5000, 9000, 20000]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        writer.add(None if k == 2 else k, ids[a:b])
    writer.close()
    reader = files.FileReader(pa.BufferReader(out.getvalue()))
    assert reader.docs == [0, 1, None, 3, 4] and reader.starts.tolist() == cuts
    for a, b in ((0, 20000), (4095, 4097), (7, 7), (19999, 20000), (8192, 12288)):
        assert (reader.ids(a, b) == ids[a:b]).all()


def test_bit_width():
    assert [files.bit_width(n) for n in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


ROWS = [
    (3, "it's a   test\n\n of 123 things!?  "), (1, None), (2, ""), (7, " leading and trailing "), (5, "a  b"), (5, "a\n b"),
    (None, "no id"), (6, "é漢字🙂 x y\u00a0z \x85 q"), (9, "x <|endoftext|> y"), (8, "word " * 9000), (10, "\t\tx \n y"),
]


def test_files_give_back_the_ids(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, number string").repartition(4)
    got = sorted((tuple(r) for r in files.token_files(docs, NAME).collect()), key=lambda r: r[1])
    assert got == expected(library, ROWS)


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in files.token_files(docs, NAME).collect()), key=lambda r: r[1])
    assert got == expected(library, rows)


def test_empty_table(spark):
    assert files.token_files(spark.createDataFrame([], "doc_id long, text string")).count() == 0
