"""Quality scores by a byte-level convolutional network in numpy.

Bytes are embedded, filters of eight bytes slide over overlapping chunks that cover the whole document, each chunk is
max-pooled per filter, and the chunks' mean and maximum go through one logistic unit. The network is trained on the
driver from a bounded sample of labelled rows; scoring is one Arrow pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoloom.llm.common import prepare, remainder, text_blocks, texts

CHUNK, STEP = 512, 448
GROUP = 4  # a filter spans two groups of bytes and moves by one
EMBED, FILTERS = 8, 24
PADDING = 256
#: Chunks that go through the filters at once.
CHUNKS_AT_ONCE = 512

#: The fit's sample: at most so many labelled rows, each of at most so many bytes (longer ones are left out, never cut).
SAMPLE_ROWS, SAMPLE_TEXT_BYTES = 2500, 65536
EPOCHS, BATCH_DOCS, RATE, SEED = 8, 16, 0.01, 7


@dataclass
class Network:
    embed: np.ndarray  # (257, EMBED), the last row for padding
    first: np.ndarray  # (GROUP * EMBED, FILTERS), left half of each filter
    second: np.ndarray  # right half
    bias: np.ndarray
    weight: np.ndarray  # (2 * FILTERS,): of the chunks' mean, then of their maximum
    offset: np.ndarray  # (1,)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.first, self.second, self.bias, self.weight, self.offset]


def new_network(seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    embed = draw(257, EMBED) * 0.5
    embed[PADDING] = 0
    wide = GROUP * EMBED
    return Network(
        embed,
        draw(wide, FILTERS) / wide**0.5,
        draw(wide, FILTERS) / wide**0.5,
        np.zeros(FILTERS, np.float32),
        draw(2 * FILTERS) * 0.1,
        np.zeros(1, np.float32),
    )


def cut(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and document of every chunk; a document has one at least, and each byte lies in one or two."""
    length = np.diff(offsets)
    count = np.maximum(1, -(-(length - (CHUNK - STEP)) // STEP))
    doc = np.repeat(np.arange(len(length)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return offsets[doc] + nth * STEP, doc


def codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes of chunks, padded."""
    at = start[:, None] + np.arange(CHUNK)
    inside = at < end[:, None]
    if not len(data):
        return np.full(at.shape, PADDING, np.int64)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], PADDING)


def _filtered(net: Network, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    groups = net.embed[chunk].reshape(len(chunk), CHUNK // GROUP, GROUP * EMBED)
    return groups, (groups @ net.first)[:, :-1] + (groups @ net.second)[:, 1:]


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter maxima of every chunk, and the chunk's document."""
    start, doc = cut(offsets)
    end, found = offsets[1:][doc], np.empty((len(start), FILTERS), np.float32)
    for low in range(0, len(start), CHUNKS_AT_ONCE):
        part = slice(low, low + CHUNKS_AT_ONCE)
        found[part] = _filtered(net, codes(data, start[part], end[part]))[1].max(1)
    return np.maximum(found + net.bias, 0), doc


def _combined(maxima: np.ndarray, doc: np.ndarray) -> np.ndarray:
    first = np.searchsorted(doc, np.arange(doc[-1] + 1))
    mean = np.add.reduceat(maxima, first) / np.diff(np.append(first, len(doc)))[:, None]
    return np.hstack([mean, np.maximum.reduceat(maxima, first)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -40, 40)))


def probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return _sigmoid(_combined(*pooled(net, data, offsets)) @ net.weight + net.offset)


def _gradients(net: Network, data: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss of a batch: the maxima pass it to the places they came from."""
    start, doc = cut(offsets)
    chunk = codes(data, start, offsets[1:][doc])
    groups, out = _filtered(net, chunk)
    place = out.argmax(1)
    each, filters = np.arange(len(chunk))[:, None], np.arange(FILTERS)
    raw = out[each, place, filters] + net.bias
    maxima = np.maximum(raw, 0)
    features = _combined(maxima, doc)
    error = ((_sigmoid(features @ net.weight + net.offset) - label) / len(label)).astype(np.float32)
    back = error[:, None] * net.weight
    share = 1 / np.bincount(doc).astype(np.float32)
    top = maxima == features[doc, FILTERS:]
    tied = np.add.reduceat(top, np.searchsorted(doc, np.arange(len(label)))).astype(np.float32)
    passed = back[doc, :FILTERS] * share[doc, None] + back[doc, FILTERS:] * top / tied[doc]
    passed = (passed * (raw > 0)).astype(np.float32)
    left, right = groups[each, place], groups[each, place + 1]
    embed = np.zeros_like(net.embed)
    for half, weights, shift in ((left, net.first, 0), (right, net.second, 1)):
        into = (passed[:, :, None] * weights.T[None]).reshape(-1, EMBED)
        at = (place + shift)[:, :, None] * GROUP + np.arange(GROUP)
        byte = chunk[each[:, :, None], at].ravel()
        for k in range(EMBED):
            embed[:, k] += np.bincount(byte, into[:, k], 257).astype(np.float32)
    embed[PADDING] = 0
    return [
        embed,
        np.einsum("cf,cfw->wf", passed, left),
        np.einsum("cf,cfw->wf", passed, right),
        passed.sum(0),
        features.T @ error,
        error.sum(keepdims=True),
    ]


def train(sample: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on batches of whole documents, in an order fixed by `seed`."""
    net = new_network(seed)
    label = np.asarray(labels, np.float32)
    if not len(label):
        net.weight[:] = 0
        return net
    share = np.clip(label.mean(), 0.01, 0.99)
    net.offset[:] = np.log(share / (1 - share))
    rng, step = np.random.default_rng(seed), 0
    first, second = ([np.zeros_like(p) for p in net.parts()] for _ in range(2))
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        rate = RATE * (1 - epoch / epochs)
        for low in range(0, len(order), BATCH_DOCS):
            rows = order[low : low + BATCH_DOCS]
            data = np.frombuffer(b"".join(sample[i] for i in rows), np.uint8)
            offsets = np.cumsum([0, *(len(sample[i]) for i in rows)])
            step += 1
            for p, g, m, v in zip(net.parts(), _gradients(net, data, offsets, label[rows]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, text_bytes: int = SAMPLE_TEXT_BYTES) -> pd.DataFrame:
    """The fit's sample: text and label of at most `rows` training rows (crc32 of the id modulo 3 is not 1), by id hash."""
    chosen = (
        labels.filter(F.col(label).isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
        .select("doc_id", F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(rows)
    )
    # At most `rows` narrow rows: the broadcast has a fixed bound.
    found = texts(docs).filter(F.octet_length("text") <= text_bytes).join(F.broadcast(chosen), "doc_id")
    # Rows that repeat an id may exceed the bound again.
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "text").limit(rows).toPandas()


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    sample = labelled(docs, labels, "quality", rows)
    return train([t.encode() for t in sample["text"]], sample["label"].tolist())


def score(docs: DataFrame, net: Network) -> DataFrame:
    """One row per document: doc_id, held_out, score (higher: label 1 likelier), predicted.

    Null and empty texts get the score of one empty chunk; a null id counts as training row. Repeated rows each give a
    row, an empty table none; other columns are ignored.
    """
    prepare(docs.sparkSession)

    @F.arrow_udf("double")
    def probability(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            found = np.empty(len(batch))
            for row, offsets, data in text_blocks(batch):
                found[row : row + len(offsets) - 1] = probabilities(net, data, offsets)
            yield pa.array(found)

    scored = texts(docs).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        probability("text").alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    return score(docs, fit(docs, labels, rows))
