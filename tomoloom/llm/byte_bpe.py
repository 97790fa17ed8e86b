"""Byte-level BPE by overlapping chunks, and decoding by concatenating raw bytes.

A text longer than a chunk is cut into chunks that overlap. Chunks are pre-tokenised by themselves; two neighbours are
stitched at the first boundary of the overlap that both found, because a match depends only on what follows it, so two
scans that share a boundary agree from there on. The stitched pieces are encoded and put together per document.

Chunks come in two sizes. Small ones are stitched inside the task that has the text; where two don't agree (one match
longer than the overlap), scanning goes on from the last stitch. Texts longer than a large chunk are dealt to tasks by
large chunks first; one whose large chunks never agree is put together again and goes through the small ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tomoloom.llm.common import prepare, texts, worker_cache

CHUNK_CHARS = 32768
OVERLAP_CHARS = 2048
#: The small chunks, inside a task.
SMALL_CHARS, SMALL_OVERLAP = 2048, 256
#: Tokens are four bytes each wherever they travel.
ID_TYPE = np.dtype("<u4")
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _codec(vocabulary: str):
    """The encoder and the bytes of every id, once per worker."""
    kept = worker_cache()
    if vocabulary not in kept:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoder = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        raw: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            raw[rank] = piece
        kept[vocabulary] = encoder, raw
    return kept[vocabulary]


def encode(text: str, vocabulary: str, step: int = SMALL_CHARS, overlap: int = SMALL_OVERLAP) -> bytes:
    """Ids of one text or stitched piece of text, little-endian, four bytes each."""
    encoder = _codec(vocabulary)[0]
    return b"".join([np.asarray(encoder.encode_ordinary(piece), ID_TYPE).tobytes() for piece in pieces(text, step, overlap)])


def decode(ids: bytes, vocabulary: str) -> bytes:
    """The raw bytes of all ids, one after the other."""
    raw = _codec(vocabulary)[1]
    return b"".join([raw[i] for i in np.frombuffer(ids, ID_TYPE).tolist()])


def _digest(ids: bytes, vocabulary: str) -> dict:
    return {
        "n_tokens": len(ids) // ID_TYPE.itemsize,
        "ids_sha256": hashlib.sha256(ids).hexdigest(),
        "decoded_sha256": hashlib.sha256(decode(ids, vocabulary)).hexdigest(),
    }


def boundaries(text: str) -> list[int]:
    """Where matches of the pattern start, up to the last one: cutting the text short may have changed that one's end."""
    import public_tokenizers
    import regex

    return [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)]


def _usable(text: str, found: list[int], low: int, high: int) -> list[int]:
    """Boundaries in [low, high) after a character that is no space: pieces on both sides then match alone as they do here."""
    return [b for b in found if low <= b < high and b and not text[b - 1].isspace()]


def pieces(text: str, step: int, overlap: int) -> list[str]:
    """The text cut where the scans of overlapping chunks meet."""
    cuts, at, skip = [0], step, 1
    scanned, seen = 0, boundaries(text[: step + overlap]) if len(text) > step + overlap else []
    while at < len(text) - overlap:
        own = boundaries(text[at : at + step + overlap])
        head = {at + b for b in _usable(text[at : at + overlap], own, 0, overlap)}
        meet = next((b for b in seen if scanned + b in head), None)
        if meet is None:
            # The chunk may have begun inside a match: go on from the last sure place, further each time.
            skip *= 2
            at += step * skip
            scanned, seen = cuts[-1], boundaries(text[cuts[-1] : at + overlap])
        else:
            cuts.append(scanned + meet)
            scanned, seen, skip = at, own, 1
            at += step
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def _stitch_points(step: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for part, text in zip(batch["part"].to_pylist(), batch["text"].to_pylist()):
                found, at = boundaries(text), part * step
                heads.append([at + b for b in _usable(text, found, 0, overlap)])
                tails.append([at + b for b in _usable(text, found, step, step + overlap)])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, kind), pa.array(tails, kind)], [*batch.schema.names, "head", "tail"]
            )

    return run


def _encode_column(vocabulary: str):
    @F.arrow_udf("binary")
    def ids(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            yield pa.array([encode(t, vocabulary) for t in batch.to_pylist()], pa.binary())

    return ids


def _digest_column(vocabulary: str, of):
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf(f"struct<{RESULT.replace(' ', ':').replace(',:', ',')}>")
    def digests(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            yield pa.array([_digest(of(value), vocabulary) for value in batch.to_pylist()], kind)

    return digests


def long_ids(long: DataFrame, vocabulary: str, step: int, overlap: int) -> DataFrame:
    """doc_id, text copies and the ids of texts longer than a chunk; rows that repeat id and text are encoded once."""
    distinct = long.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    last = F.greatest(F.ceil((F.length("text") - overlap) / step), F.lit(1)) - 1
    key = F.struct("doc_id", F.sha2("text", 256).alias("sha")).alias("key")
    chunks = distinct.select(key, "copies", "text", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("part")).select(
        "key", "copies", "part", F.expr(f"substring(text, part * {step} + 1, {step + overlap})").alias("text")
    )
    spread = chunks.repartition("key", "part")
    scanned = spread.mapInArrow(
        _stitch_points(step, overlap),
        StructType([*spread.schema, StructField("head", ArrayType(LongType())), StructField("tail", ArrayType(LongType()))]),
    )
    by_part = Window.partitionBy("key").orderBy("part")
    joined = scanned.withColumn(
        "start",
        F.when(F.col("part") == 0, 0).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(by_part)))),
    )
    stitched = joined.withColumn("stop", F.lead("start").over(by_part)).withColumn(
        "whole", F.max(F.col("start").isNull()).over(Window.partitionBy("key"))
    )
    # Between the stitches each chunk has its own pieces; without stitches, its part of the text up to the next chunk.
    cut = F.when(
        ~F.col("whole"),
        F.expr(f"substring(text, start - part * {step} + 1, coalesce(stop - start, {step + overlap}))"),
    ).otherwise(
        F.when(F.lead("part").over(by_part).isNull(), F.col("text")).otherwise(F.substring("text", 1, step))
    )
    pieces = stitched.withColumn("piece", cut).select("key", "copies", "part", "whole", "piece")
    agreed = pieces.filter(~F.col("whole")).select(
        "key", "copies", "part", _encode_column(vocabulary)("piece").alias("ids")
    )
    agreed = agreed.groupBy("key").agg(
        F.first("copies").alias("copies"),
        F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"]).alias("ids"),
    )
    alone = pieces.filter("whole").groupBy("key").agg(
        F.first("copies").alias("copies"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), "").alias(
            "text"
        ),
    )
    alone = alone.select("key", "copies", F.array(_encode_column(vocabulary)("text")).alias("ids"))
    return agreed.unionByName(alone)


def round_trip(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.tiktoken",
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The digests are of the ids (little-endian, four bytes each) and of the bytes that decoding them gives. Null and empty
    texts have no ids; very long ones are dealt to several tasks. Repeated rows each give a row; null ids stay; an empty
    table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = texts(docs)
    limit = chunk + overlap
    short = rows.filter(F.length("text") <= limit)
    whole = _digest_column(vocabulary, lambda text: encode(text, vocabulary))
    together = _digest_column(vocabulary, b"".join)
    columns = ["doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256"]
    quick = short.select("doc_id", whole("text").alias("r")).select(*columns)
    long = long_ids(rows.filter(F.length("text") > limit), vocabulary, chunk, overlap)
    slow = long.select("key.doc_id", "copies", together("ids").alias("r")).select(
        *columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    )
    return quick.unionByName(slow.drop("copy"))
