"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over the words of a text and the words' beginnings; each model also sees the earlier
categories' probabilities. The training values of those are out-of-fold predictions, so a later model learns from them
as they will be on unseen documents. The last category is the label itself. Fitted on the driver from a bounded sample
of labelled rows; scoring is one Arrow pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoloom.llm.common import prepare, remainder, span_ids, text_blocks, texts, word_spans
from tomoloom.llm.quality_cnn import labelled

#: Categories in chain order, marked in training rows by the toxic label together with one of the words.
CATEGORIES = {
    "intellect": "idiot moron stupid dumb fool imbecile".split(),
    "worth": "worthless loser pathetic trash garbage useless".split(),
    "contempt": "scum disgusting clown vile filth creep".split(),
}
LABEL = "toxic"
SAMPLE_ROWS, FEATURES, FOLDS, RIDGE = 4000, 128, 5, 0.05
#: Bits of a feature's number.
FEATURE_BITS = 22
#: Bytes of the beginnings of words that are features too; inflected forms share them.
BEGINNINGS = (4, 5, 6)

_byte = np.arange(256)
#: Words are runs of ASCII letters, digits and any byte of a longer character.
BREAKS = ~(((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128))


@dataclass
class Chain:
    vocabulary: np.ndarray  # sorted word ids
    weights: list[np.ndarray]  # per category: of the words, the earlier categories, and one constant
    names: list[str]


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed numbers of whole words and of their beginnings, and the index of each one's text."""
    low, start, length, doc = word_spans(data, offsets, BREAKS)
    ids, docs = [span_ids(low, start, length)], [doc]
    for size in BEGINNINGS:
        longer = length > size
        begun = span_ids(low, start[longer], np.full(longer.sum(), size))
        ids.append(~begun)
        docs.append(doc[longer])
    return np.concatenate(ids) >> np.uint64(64 - FEATURE_BITS), np.concatenate(docs)


def word_id(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(features_of(data, np.array([0, len(data)]))[0][0])


def presence(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and word index of each pair of a document and a known feature that it holds."""
    ids, doc = features_of(data, offsets)
    if not len(vocabulary) or not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    likely = np.zeros(1 << 16, bool)
    likely[vocabulary & np.uint64(0xFFFF)] = True
    maybe = np.flatnonzero(likely[ids & np.uint64(0xFFFF)])
    at = np.minimum(np.searchsorted(vocabulary, ids[maybe]), len(vocabulary) - 1)
    known = vocabulary[at] == ids[maybe]
    pairs = np.unique(doc[maybe[known]] * len(vocabulary) + at[known])
    return pairs // len(vocabulary), pairs % len(vocabulary)


def _matrix(docs: list[bytes], vocabulary: np.ndarray) -> np.ndarray:
    found = np.zeros((len(docs), len(vocabulary)))
    for i, text in enumerate(docs):
        data = np.frombuffer(text, np.uint8)
        found[i, presence(data, np.array([0, len(data)]), vocabulary)[1]] = 1
    return found


def _select(docs: list[bytes], label: np.ndarray, most: int) -> np.ndarray:
    """Features whose presence differs most between the classes (chi-square), among those in five documents or more."""
    if not docs:
        return np.zeros(0, np.uint64)
    total, positive = (np.zeros(1 << FEATURE_BITS, np.int32) for _ in range(2))
    for text, hit in zip(docs, label):
        data = np.frombuffer(text, np.uint8)
        held = np.unique(features_of(data, np.array([0, len(data)]))[0])
        total[held] += 1
        positive[held] += int(hit)
    ids = np.flatnonzero(total >= 5)
    total, positive = total[ids], positive[ids]
    n, share = len(docs), label.mean()
    expected = total * share
    spread = np.maximum(expected * (1 - share) * (1 - total / n), 1e-9)
    value = (positive - expected) ** 2 / spread
    best = np.argsort(-value, kind="stable")[:most]
    return np.sort(ids[best[value[best] > 0]]).astype(np.uint64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the constant is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    shrink = np.full(x.shape[1], RIDGE)
    shrink[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - y) + shrink * w
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(shrink), slope)
    return w


def train(docs: list[bytes], label: np.ndarray, features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Without rows every probability is one half; a category without positive rows gets a small constant."""
    names = [*CATEGORIES, LABEL]
    if not len(docs):
        return Chain(np.zeros(0, np.uint64), [np.zeros(i + 1) for i in range(len(names))], names)
    vocabulary = _select(docs, label, features)
    x = _matrix(docs, vocabulary)
    fold = np.arange(len(docs)) % folds
    weights = []
    for name in names:
        y = label
        if name in CATEGORIES:
            seeds = np.sort(np.array([word_id(w) for w in CATEGORIES[name]], np.uint64))
            y = label * _matrix(docs, seeds).any(1)
        unseen = np.empty(len(docs))
        for k in range(folds):
            out = fold == k
            if out.all():
                unseen[:] = y.mean()
            elif out.any():
                w = _logistic(x[~out], y[~out])
                unseen[out] = _sigmoid(x[out] @ w[:-1] + w[-1])
        weights.append(_logistic(x, y))
        x = np.hstack([x, unseen[:, None]])
    return Chain(vocabulary, weights, names)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Chain:
    sample = labelled(docs, labels, LABEL, rows)
    return train([t.encode() for t in sample["text"]], sample["label"].to_numpy(float))


def predict(chain: Chain, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities, a row per document and a column per category."""
    doc, word = presence(data, offsets, chain.vocabulary)
    count, known = len(offsets) - 1, len(chain.vocabulary)
    out = np.zeros((count, len(chain.names)))
    for k, w in enumerate(chain.weights):
        value = np.bincount(doc, w[word], count) if len(doc) else np.zeros(count)
        out[:, k] = _sigmoid(value + out[:, :k] @ w[known : known + k] + w[-1])
    return out


def chain_column(chain: Chain, text: Column) -> Column:
    """A struct of probabilities per text, one field per category; null texts count as empty."""
    kind = pa.struct([(n, pa.float64()) for n in chain.names])

    @F.arrow_udf("struct<" + ",".join(f"{n}:double" for n in chain.names) + ">")
    def probabilities(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            found = np.zeros((len(batch), len(chain.names)))
            for row, offsets, data in text_blocks(batch):
                found[row : row + len(offsets) - 1] = predict(chain, data, offsets)
            yield pa.StructArray.from_arrays([pa.array(c) for c in found.T], fields=list(kind))

    return probabilities(F.coalesce(text, F.lit("")))


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, a probability per category, toxic (the last one is 0.5 or more).

    Null and empty texts hold no words and get the chain's constants; a null id counts as training row. Repeated rows
    each give a row, an empty table none; other columns are ignored.
    """
    prepare(docs.sparkSession)
    chain = fit(docs, labels, rows)
    scored = texts(docs).select("doc_id", chain_column(chain, F.col("text")).alias("p"))
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        *[F.col(f"p.{n}").alias(f"p_{n}") for n in chain.names],
        (F.col(f"p.{LABEL}") >= 0.5).alias("toxic"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """`docs` without the documents that the chain calls toxic, all columns kept, whatever their names.

    Null and empty texts, texts of any length, repeated rows and rows without an id are judged by their text like all others.
    """
    prepare(docs.sparkSession)
    chain = fit(docs, labels, rows)
    return docs.filter(chain_column(chain, F.col("text"))[LABEL] < 0.5)
