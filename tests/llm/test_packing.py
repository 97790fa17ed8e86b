"""Packing: the tree against a plain first fit, the block encoder against the library, pieces that restore every text."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tomoloom.llm import packing
from tomoloom.llm.word_encoder import BlockEncoder

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


@pytest.fixture(scope="module")
def codec():
    return BlockEncoder(NAME)


def plain_first_fit(sizes, capacity):
    bins, placed = [], {}
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, used in enumerate(bins) if used + sizes[item] <= capacity), len(bins))
        if k == len(bins):
            bins.append(0)
        placed[item] = k, bins[k]
        bins[k] += sizes[item]
    return [placed[i] for i in range(len(sizes))]


@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
@settings(max_examples=200, deadline=None)
def test_tree_is_first_fit_decreasing(sizes):
    bins, offsets = packing.first_fit_decreasing(np.array(sizes), 64)
    assert list(zip(bins.tolist(), offsets.tolist())) == plain_first_fit(sizes, 64)


def test_no_room():
    rooms = packing.Rooms(2, 10)
    assert [rooms.place(n) for n in (6, 7, 4, 3)] == [(0, 10), (1, 10), (0, 4), (1, 3)]
    with pytest.raises(ValueError):
        rooms.place(1)


ALPHABET = "ab Ztsre'\"\n\t.,!?()-_12 é×÷ñÀ漢🙂  \x85\x1ć|<>"


@given(st.lists(st.text(ALPHABET, max_size=40), max_size=8))
@settings(max_examples=400, deadline=None)
def test_block_encoder_equals_the_library(codec, library, texts):
    ids, ends = codec.encode(pa.array(texts, pa.string()))
    for text, low, high in zip(texts, ends, ends[1:]):
        assert ids[low:high].tolist() == library.encode(text, add_special_tokens=False).ids


def test_block_encoder_on_special_cases(codec, library):
    texts = [None, "", " ", "x <|endoftext|> y", "it's we'll 'sx \"'s ('t", "word " * 3000, "a" * 5000, "end\n\n", "a\n b\n\nc  d "]
    ids, ends = codec.encode(pa.array(texts))
    for text, low, high in zip(texts, ends, ends[1:]):
        assert ids[low:high].tolist() == library.encode(text or "", add_special_tokens=False).ids


def whole(rows, docs, library, capacity):
    """Every piece in its place: texts restored, sequences gapless and never too long."""
    texts, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and 0 < r.length <= capacity
        texts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids.tolist()))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    found = []
    for (doc_id, tokens), parts in texts.items():
        # Rows that share an id and a length interleave: take one part of each start per row.
        by_start = {}
        for start, ids in parts:
            by_start.setdefault(start, []).append(ids)
        assert sum(len(i) for v in by_start.values() for i in v) == tokens * len(by_start[0])
        if len(by_start[0]) == 1:
            found.append((doc_id, [i for s in sorted(by_start) for i in by_start[s][0]]))
        else:
            found += [(doc_id, None)] * len(by_start[0])
    expected = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in docs]
    many = {(i, len(e)) for i, e in expected if sum(i == j and len(e) == len(f) for j, f in expected) > 1}
    expected = [(i, None if (i, len(e)) in many else e) for i, e in expected]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    return sequences


@pytest.mark.parametrize("capacity, group", [(32, 200), (64, 1 << 20), (1024, 1)])
def test_pieces_restore_texts(spark, library, capacity, group):
    rng = random.Random(capacity)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "it's", "x.", "ñandú"]) for _ in range(rng.randrange(120)))) for i in range(150)]
    docs += [(7, "same"), (7, "same"), (None, "no id"), (None, None), (200, ""), (201, "long " * 4000)]
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, length int").repartition(3)
    whole(packing.pack(table, capacity=capacity, group_ids=group).collect(), docs, library, capacity)


def test_digests_and_little_padding(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = packing.pack(docs)
    sequences = whole(packed.collect(), [(r.doc_id, r.text) for r in docs.collect()], library, 1024)
    used = sum(length for parts in sequences.values() for _, length in parts)
    # A task's last sequence may be half empty; the whole is within two of the fewest possible per task.
    tasks = max(4, spark.sparkContext.defaultParallelism)
    assert len(sequences) <= -(-used // 1024) + 2 * tasks
    ids = {(r.doc_id, r.start): r.ids for r in packed.collect()}
    for r in packing.with_digests(packed).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id, r.start])


def test_same_result_twice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(packing.pack(docs).collect()) == sorted(packing.pack(docs).collect())


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
