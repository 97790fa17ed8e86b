"""Log probabilities of texts by a probabilistic suffix tree, beside a word-count baseline.

The tree predicts the next byte of a text's normal form: its lower-cased words, each followed by a space, and an end
mark. Its states are contexts of up to DEPTH bytes. A context is a candidate if it stands LEAST_COUNT times or more in
the training texts, so the tree grows with them, and it is kept if its next-byte distribution diverges from that of the
context one byte shorter. Distributions are smoothed towards the shorter context; a byte is scored in the state of the
longest kept suffix of what stands before it.

Counting covers all texts: tasks count, Spark adds up. Sums, divergence and smoothed values are joins of one table per
depth (`_values`); every (context, byte) that stands in a text gets its value, and the driver holds no tree. Words and
(context, byte) pairs that make up a share of WORD_SHARE or GRAM_SHARE of the training tokens or bytes travel to the
tasks. For all others, documents are gathered in chunks of some CHUNK_BYTES; a chunk asks once for every key that it
holds, and the parts of the table of values answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomoloom.functions.storage import discard, materialize
from tomoloom.llm.common import Lookup, Tally, eight_bytes, keyed, mix, prepare, remainder, span_ids, text_blocks, word_spans

#: A context and the byte after it share one 64-bit number, so seven is the most.
DEPTH = 5
#: Occurrences a context needs: a share of the training bytes (none is asked for) and an absolute count.
SHARE, LEAST_COUNT = 0.0, 4
DIVERGENCE = 0.01
PRIOR = 8.0
#: What travels to the tasks, at most 1 / WORD_SHARE words and 1 / GRAM_SHARE values; the rest is joined.
WORD_SHARE, GRAM_SHARE = 1e-5, 5e-7
SPACE, END = 32, 10
#: Kinds of counted keys; HELD are bytes of held-out texts, which count nothing.
WORD, GRAM, HELD = 0, 1, 2
#: Bytes of text, about, that are scored together, so that a key that several of them have is asked for once.
CHUNK_BYTES = 16 << 20
#: Keys of a part of a table of values and occurrences of all of them, about.
PART_KEYS, PART_PLACES = 1 << 18, 1 << 22


def symbols(low: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal forms of a run of texts: bytes with DEPTH end marks before each text, the scored places, their texts."""
    words = np.bincount(doc, minlength=docs)
    size = np.bincount(doc, length, docs).astype(np.int64) + words + 1
    begin = np.cumsum(size + DEPTH) - size
    out = np.full(int((size + DEPTH).sum()), END, np.uint8)
    # Texts of one run lie one behind the other, each word with its space.
    at = np.cumsum(length + 1) - length - 1
    first = np.searchsorted(doc, np.arange(docs))
    shift = begin - np.append(at, 0)[np.minimum(first, len(at))] if len(at) else begin
    place = at + shift[doc]
    inside = np.repeat(place - (np.cumsum(length) - length), length) + np.arange(length.sum())
    source = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
    out[inside] = low[source]
    out[place + length] = SPACE
    scored = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return out, scored, np.repeat(np.arange(docs), size)


def grams(out: np.ndarray, scored: np.ndarray) -> np.ndarray:
    """The DEPTH bytes before each scored place and the byte there, oldest byte lowest."""
    return eight_bytes(out)[scored - DEPTH] & np.uint64((1 << 8 * (DEPTH + 1)) - 1)


def _counts(rows: DataFrame) -> DataFrame:
    """kind, key, n: words of the training texts, and bytes of all texts with what stands before them.

    n counts training texts only; bytes that only held-out texts have are there with 0.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {WORD: Tally(), GRAM: Tally(), HELD: Tally()}

        def rows_of(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            if kind == HELD:
                kind, n = GRAM, np.zeros_like(n)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"]
            )

        for batch in batches:
            out = batch["held_out"]
            for kind, part in ((GRAM, batch.filter(pc.invert(out))), (HELD, batch.filter(out))):
                for _, offsets, data in text_blocks(part["text"]):
                    low, start, length, doc = word_spans(data, offsets)
                    if kind == GRAM:
                        tallies[WORD].add(span_ids(low, start, length))
                    tallies[kind].add(grams(*symbols(low, start, length, doc, len(offsets) - 1)[:2]))
            for kind, tally in tallies.items():
                if tally.held > tally.most // 2:
                    yield rows_of(kind, *tally.take())
        for kind, tally in tallies.items():
            yield rows_of(kind, *tally.take())

    counted = rows.select("text", "held_out").mapInArrow(count, "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _values(found: DataFrame, total: int) -> DataFrame:
    """key, n, value: log10 probability of each counted byte after the DEPTH bytes before it.

    A table per depth holds context and next byte (key), its count and its context's. A key's place one depth up is the
    key without its oldest byte, and so is a context's.
    """
    context = lambda depth: F.col("key").bitwiseAND(F.lit((1 << 8 * depth) - 1)).alias("context")
    up = F.shiftrightunsigned("key", 8).alias("up")
    levels, counted = {}, found.select("key", "n")
    for depth in range(DEPTH, -1, -1):
        whole = Window.partitionBy(context(depth))
        levels[depth] = materialize(counted.select("key", "n", F.sum("n").over(whole).alias("sums")))
        counted = levels[depth].groupBy(F.shiftrightunsigned("key", 8).alias("key")).agg(F.sum("n").alias("n"))
    kept = {}
    for depth in range(DEPTH, 0, -1):
        above = levels[depth - 1].filter("n > 0").select(F.col("key").alias("up"), (F.col("n") / F.col("sums")).alias("above"))
        share = F.col("n") / F.col("sums")
        gain = F.sum(share * F.log(share / F.col("above")))
        apart = (
            levels[depth]
            .filter((F.col("n") > 0) & (F.col("sums") >= max(SHARE * total, LEAST_COUNT)))
            .select(context(depth), up, "n", "sums")
            .join(above, "up")
            .groupBy("context")
            .agg(gain.alias("gain"))
            .filter(F.col("gain") >= DIVERGENCE)
            .select("context")
        )
        if depth < DEPTH:
            # A kept context keeps all its suffixes.
            apart = apart.unionByName(kept[depth + 1].select(F.shiftrightunsigned("context", 8).alias("context"))).distinct()
        kept[depth] = materialize(apart)
    chance = levels[0].select("key", "n", ((F.col("n") + 1) / F.lit(total + 256.0)).alias("p"))
    for depth in range(1, DEPTH + 1):
        chance = (
            levels[depth]
            .select("key", "n", "sums", context(depth), up)
            .join(chance.select(F.col("key").alias("up"), F.col("p").alias("above")), "up")
            .join(kept[depth].withColumn("kept", F.lit(True)), "context", "left")
            .select("key", "n", F.when(F.col("kept"), (F.col("n") + PRIOR * F.col("above")) / (F.col("sums") + PRIOR)).otherwise(F.col("above")).alias("p"))
        )
    values = materialize(chance.select("key", "n", F.log10("p").alias("value")))
    for table in (*levels.values(), *kept.values()):
        discard(table)
    return values


def _held(frame: DataFrame) -> tuple[Lookup, np.ndarray]:
    found = frame.toPandas()
    return Lookup(found["key"].to_numpy(np.int64).view(np.uint64)), found["value"].to_numpy(float)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of a table that a key is in."""
    return (mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(parts)).astype(np.int64)


def _asked(chunks: DataFrame, common: Broadcast, parts: dict[int, int]) -> DataFrame:
    """kind, part, chunk, keys: what each chunk of documents needs to know, a row per part of the table it is in."""

    def ask(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, chunk = {WORD: Tally(), GRAM: Tally()}, None
        for batch in group:
            chunk = batch["chunk"][0].as_py()
            for _, offsets, data in text_blocks(batch["text"]):
                low, start, length, doc = word_spans(data, offsets)
                found = {WORD: span_ids(low, start, length), GRAM: grams(*symbols(low, start, length, doc, len(offsets) - 1)[:2])}
                for kind, keys in found.items():
                    wanted[kind].add(keys[common.value[kind][0].find(keys) < 0])
        for kind, tally in wanted.items():
            keys = tally.take()[0]
            part = _part(keys, parts[kind])
            order = np.argsort(part, kind="stable")
            keys, part = keys[order], part[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
            yield pa.RecordBatch.from_pydict(
                {
                    "kind": pa.array(np.full(len(first), kind, np.int32)),
                    "part": pa.array(part[first]),
                    "chunk": pa.array(np.full(len(first), chunk or 0, np.int64)),
                    "keys": pa.array([keys[a:b].tobytes() for a, b in zip(first, [*first[1:], len(keys)])], pa.binary()),
                }
            )

    return chunks.groupBy("chunk").applyInArrow(ask, "kind int, part long, chunk long, keys binary")


def _parts(keys: pa.Array, parts: pa.Array) -> pa.Array:
    return pa.array(_part(keys.to_numpy(zero_copy_only=False).view(np.uint64), parts[0].as_py() if len(parts) else 1))


def _answer(asked: pa.Table, values: pa.Table) -> pa.Table:
    """kind, chunk, keys and the values of those that the table has."""
    table = Lookup(values["key"].to_numpy().view(np.uint64))
    value, keys, found = values["value"].to_numpy(), [], []
    for held in asked["keys"]:
        own = np.frombuffer(held.as_buffer(), np.uint64)
        at = table.find(own)
        keys.append(own[at >= 0].tobytes())
        found.append(value[at[at >= 0]].tobytes())
    return pa.table({"kind": asked["kind"], "chunk": asked["chunk"], "keys": pa.array(keys, pa.binary()), "found": pa.array(found, pa.binary())})


def _scored(common: Broadcast, floor: float, end: tuple[float, int]):
    """Figures of a chunk's documents from the common values and those that came for the chunk."""

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        own = {}
        for kind in (WORD, GRAM):
            rows = answers.filter(pc.equal(answers["kind"], kind))
            keys, found = (b"".join(rows[c].to_pylist()) for c in ("keys", "found"))
            own[kind] = Lookup(np.frombuffer(keys, np.uint64)), np.frombuffer(found, np.float64)

        def value(kind: int, keys: np.ndarray) -> np.ndarray:
            """NaN where neither table has the key."""
            out = np.full(len(keys), np.nan)
            for table, held in (common.value[kind], own[kind]):
                left = np.flatnonzero(np.isnan(out))
                at = table.find(keys[left])
                out[left[at >= 0]] = held[at[at >= 0]]
            return out

        figures = []
        for _, offsets, data in text_blocks(docs["text"]):
            many = len(offsets) - 1
            low, start, length, doc = word_spans(data, offsets)
            word = value(WORD, span_ids(low, start, length))
            known = ~np.isnan(word)
            out, scored, of = symbols(low, start, length, doc, many)
            figures.append(
                (
                    np.bincount(doc, minlength=many) + 1,
                    np.bincount(doc[known], minlength=many) + end[1],
                    np.bincount(doc, np.where(known, word, floor), many) + end[0],
                    np.bincount(of, value(GRAM, grams(out, scored)), many),
                )
            )
        columns = [np.concatenate(c) for c in zip(*figures)] if figures else [np.zeros(0, t) for t in (int, int, float, float)]
        names = ["n_tokens", "n_known", "base_score", "score"]
        return pa.table([docs["doc_id"], docs["held_out"], *(pa.array(c) for c in columns)], ["doc_id", "held_out", *names])

    return score


def text_scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id modulo 7 is 2 are held out, all others train; a null id trains. Null and empty texts
    have the end token alone. Without training rows every count is 0 and the tree predicts all bytes alike. Repeated
    rows each give a row and train each; an empty table gives none; other columns are ignored. Words are counted by a
    64-bit hash.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = keyed(docs)
    out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out")
    counts = materialize(_counts(rows.withColumn("held_out", out)))
    words = counts.filter(F.col("kind") == WORD)
    seen = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).first()
    read = rows.agg(F.count_if(~out).alias("ends"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ends = read.ends
    total, distinct = (seen.n or 0) + ends, seen.distinct + (ends > 0)
    floor = float(total + distinct + 1)
    places = counts.filter(F.col("kind") == GRAM)
    size = places.agg(F.sum("n")).first()[0] or 0
    values = {
        WORD: words.select("key", "n", F.log10((F.col("n") + 1) / floor).alias("value")),
        GRAM: _values(places, size),
    }
    often = {WORD: WORD_SHARE * total, GRAM: GRAM_SHARE * size}
    # Bounded: at most 1 / WORD_SHARE words and 1 / GRAM_SHARE bytes with their contexts.
    common = spark.sparkContext.broadcast({k: _held(v.filter(F.col("n") >= max(2, often[k])).select("key", "value")) for k, v in values.items()})
    rare = {k: v.filter(F.col("n") < max(2, often[k])).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first() for k, v in values.items()}
    parts = {k: 1 + max(many // PART_KEYS, times // PART_PLACES) for k, (many, times) in rare.items()}
    chunks = rows.select(
        F.pmod(F.xxhash64("ref"), F.lit(1 + (read.bytes or 0) // CHUNK_BYTES)).alias("chunk"), "doc_id", out, "text"
    )
    part = F.arrow_udf(_parts, "long")
    table = None
    for kind, frame in values.items():
        one = frame.filter(F.col("n") < max(2, often[kind])).select(F.lit(kind).alias("kind"), part("key", F.lit(parts[kind])).alias("part"), "key", "value")
        table = one if table is None else table.unionByName(one)
    answers = (
        _asked(chunks, common, parts)  # the same columns as below, so that one exchange serves both
        .groupBy("kind", "part")
        .cogroup(table.groupBy("kind", "part"))
        .applyInArrow(_answer, "kind int, chunk long, keys binary, found binary")
    )
    end = float(np.log10((ends + 1) / floor)), int(ends > 0)
    figures = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored(common, -float(np.log10(floor)), end), figures)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
