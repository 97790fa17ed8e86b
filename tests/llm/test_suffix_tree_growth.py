"""Contexts are kept by an absolute count, however large the corpus is; dealing out the work changes no score."""

import pytest
import test_suffix_tree_lm as plain

from tomoloom.llm import suffix_tree_lm as lm


def test_rare_contexts_count_in_a_large_corpus(spark, monkeypatch):
    rows = [(i, "the cat sat on the mat and ran to the end " * 33) for i in range(560)]
    rare = [i for i in range(1000, 1100) if not plain.held(i)][:5] + [next(i for i in range(1000, 1100) if plain.held(i))]
    rows += [(i, "zqj the cat") for i in rare]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.text_scores(docs).filter("doc_id >= 1000").collect()}
    monkeypatch.setattr(lm, "SHARE", 0.0)
    counts, kept = plain.plain_tree(rows)
    training = sum(sum(n.values()) for n in counts[0].values())
    assert training * 1e-5 > 6 and {b"z", b"q", b"j "} <= kept
    assert got == {i: pytest.approx(plain.plain_score(t, counts, kept), rel=1e-9) for i, t in rows if i >= 1000}


def test_pairs_that_are_joined_score_as_those_that_travel(spark, monkeypatch):
    rows = [(i, f"word{i % 7} other{i % 5} {'last' * (i % 3)}") for i in range(60)]
    monkeypatch.setattr(lm, "GRAM_SHARE", 0.02)
    plain.check(spark, rows)


def test_many_chunks_and_parts_score_as_one(spark, monkeypatch):
    rows = [(i, f"word{i % 7} other{i % 5} {'last' * (i % 3)} own{i}") for i in range(80)] + [(None, "word1"), (7, None), (7, "word1 " * 900)]
    monkeypatch.setattr(lm, "CHUNK_BYTES", 300)
    monkeypatch.setattr(lm, "PART_KEYS", 20)
    monkeypatch.setattr(lm, "GRAM_SHARE", 0.02)
    monkeypatch.setattr(lm, "WORD_SHARE", 0.05)
    plain.check(spark, rows)


def test_ids_of_another_type_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (2, "a c", 6, "y")], "doc_id int, text string, chunk int, ref string")
    found = lm.text_scores(docs)
    assert found.schema["doc_id"].dataType.simpleString() == "int"
    assert sorted((r.doc_id, r.n_tokens) for r in found.collect()) == [(1, 3), (2, 3)]
