"""Removal of long repeated byte strings with suffix arrays per shard.

Only strings that can repeat are sorted. Every string of LENGTH bytes has one content-defined anchor, the least of the
hashed GRAM-byte strings in it; equal strings have equal anchors. Neighbouring strings with the same anchor form a piece
of text, and pieces travel as an anchor and a digest. An anchor that occurs once has no repeats. Pieces with equal
anchor and digest are equal, so all of their strings repeat. What is left, anchors with different pieces, is dealt out to
shards by anchor, one copy of each piece.

In a shard, the suffixes of all pieces are ordered by Larsson-Sadakane refinement: an order by eight bytes, then rounds
that double the depth and touch unsorted groups only. Kasai's walk gives common prefixes; suffixes that share LENGTH
bytes are repeats. An anchor with very many pieces is split over several shards. They are merged afterwards: each sends
the sorted fingerprints of its strings to the range that owns them, where every run is looked up in the others by binary
search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoloom.functions.storage import materialize
from tomoloom.llm.common import eight_bytes, keyed, mix, prepare, sieve, worker_cache

LENGTH, GRAM = 200, 32
#: Bytes of text in one numpy pass; longer texts are passed in parts that overlap.
PART_BYTES = 1 << 20
#: Bytes of pieces in one suffix array, and distinct pieces of one anchor in one shard.
SHARD_BYTES, SHARD_PIECES = 1 << 21, 2048
PLACE_BITS = np.uint64(24)
_POWER = 0x9E3779B97F4A7C15


def parts(offsets: np.ndarray, data: np.ndarray, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts or parts of a text of about `size` bytes: text index, place in the text, offsets and bytes."""
    size = size or PART_BYTES
    doc, begin, pieces, held = [], [], [], 0

    def run():
        ends = np.cumsum([0, *(len(p) for p in pieces)])
        return np.array(doc), np.array(begin), ends, np.concatenate(pieces)

    for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(low, max(high - LENGTH + 1, low), size):
            piece = data[at : min(at + size + LENGTH - 1, high)]
            doc.append(i)
            begin.append(at - low)
            pieces.append(piece)
            held += len(piece)
            if held >= size:
                yield run()
                doc, begin, pieces, held = [], [], [], 0
    if pieces:
        yield run()


def _powers(count: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    kept = worker_cache()
    if "powers" not in kept or kept["powers"].shape[1] < count:
        size = max(count, PART_BYTES * 5 // 2)
        inverse = pow(_POWER, -1, 1 << 64)
        both = np.ones((2, size), np.uint64)
        both[0, 1:], both[1, 1:] = _POWER, inverse
        kept["powers"] = np.cumprod(both, axis=1, dtype=np.uint64)
    return kept["powers"]


def anchored(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first string, number of strings and digest of every piece. Strings do not cross offsets."""
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < LENGTH:
        return empty
    eight = mix(eight_bytes(data) * np.uint64(1))
    half = mix(eight[:-8] ^ (eight[8:] * np.uint64(0xC2B2AE3D27D4EB4F)))
    gram = mix(half[:-16] ^ (half[16:] * np.uint64(0x165667B19E3779F9)))[: len(data) - GRAM + 1]
    place = np.arange(len(gram), dtype=np.uint64)
    least = gram >> PLACE_BITS << PLACE_BITS | place
    wide, want = 1, LENGTH - GRAM + 1
    while wide * 2 <= want:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < want:
        least = np.minimum(least[: len(least) - (want - wide)], least[want - wide :])
    at = (least & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    valid = np.zeros(len(at) + 1, bool)
    length = np.diff(offsets)
    for low, count in zip(offsets[:-1][length >= LENGTH].tolist(), (length[length >= LENGTH] - LENGTH + 1).tolist()):
        valid[low : low + count] = True
    valid = valid[: len(at)]
    change = np.append(True, (at[1:] != at[:-1]) | (valid[1:] != valid[:-1]))
    change[offsets[(offsets > 0) & (offsets < len(at))]] = True
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(at)))
    keep = valid[first]
    first, count = first[keep], count[keep]
    powers = _powers(len(data) + 1)
    total = np.append(np.uint64(0), np.cumsum(eight * powers[0, : len(eight)], dtype=np.uint64))
    stop = first + count + LENGTH - 1 - 7
    digest = (total[stop] - total[first]) * powers[1, first]
    return gram[at[first]], first, count, mix(digest ^ mix(count.astype(np.uint64)))


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places in the order of the bytes from there on; the end counts as lowest.

    The order is complete: Kasai's walk would overstate common prefixes where an order stops at some depth.
    """
    n = len(data)
    key = eight_bytes(data).byteswap()
    order = np.argsort(key)
    new = np.append(True, key[order[1:]] != key[order[:-1]])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    # A rank is the place of the last member of its group, so a split leaves other ranks as they are.
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start + size - 1, size)
    height = 8
    while len(open_ := np.flatnonzero(np.repeat(size > 1, size))):
        places = order[open_]
        beyond = places + height - n
        # What is over goes first, the shorter the lower.
        follow = np.where(beyond < 0, rank[np.minimum(places + height, n - 1)], -1 - beyond)
        both = rank[places] * (2 * n + 2 * height) + follow
        by = np.argsort(both)
        places, both = places[by], both[by]
        order[open_] = places
        new = np.append(True, both[1:] != both[:-1])
        begin = np.flatnonzero(new)
        run = np.diff(np.append(begin, len(places)))
        rank[places] = np.repeat(open_[begin + run - 1], run)
        flags = np.ones(n, bool)
        flags[open_] = new
        start = np.flatnonzero(flags)
        size = np.diff(np.append(start, n))
        height *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """For each place in the order, bytes shared with the one before, counted up to `most`.

    Kasai's walk in text order: a place shares at least one byte less than the place before it in the text did. All
    stretches between `starts` are walked side by side.
    """
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    packed = eight_bytes(data)
    shared = np.zeros(n, np.int64)
    ends = np.append(starts[1:], n)
    length = ends - starts
    by = np.argsort(-length, kind="stable")
    starts, length = starts[by], length[by]
    held = np.zeros(len(starts), np.int64)
    for step in range(int(length.max()) if len(length) else 0):
        alive = int(np.searchsorted(-length, -step, "left"))
        at = starts[:alive] + step
        other = before[at]
        h = np.maximum(held[:alive] - 1, 0)
        h[other < 0] = 0
        left = np.flatnonzero(other >= 0)
        while len(left):
            a, b = at[left] + h[left], other[left] + h[left]
            room = n - np.maximum(a, b)
            differ = packed[np.minimum(a, n - 1)] ^ packed[np.minimum(b, n - 1)]
            same = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            gained = np.minimum(np.where(differ == 0, 8, same), np.maximum(room, 0))
            h[left] += gained
            left = left[(gained == 8) & (h[left] < most)]
        held[:alive] = h
        shared[at] = np.minimum(h, most)
    rank_of = np.empty(n, np.int64)
    rank_of[order] = np.arange(n)
    out = np.empty(n, np.int64)
    out[rank_of] = shared
    return out


def repeats(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of LENGTH bytes in a shard's pieces: piece and place of each, and the number of its class."""
    size = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.cumsum(size) - size
    order = suffix_array(data)
    shared = common_prefixes(data, order, starts)
    owner = np.searchsorted(starts, order, "right") - 1
    whole = order + LENGTH <= starts[owner] + size[owner]
    # Every member of a run shares LENGTH bytes with the next; those that leave their piece do not count.
    classes = np.cumsum(shared < LENGTH)
    return owner[whole], order[whole] - starts[owner[whole]], classes[whole]


def _ranges(ref: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring places: ref, first, last."""
    order = np.lexsort((place, ref))
    ref, place = ref[order], place[order]
    new = np.append(True, (ref[1:] != ref[:-1]) | (place[1:] != place[:-1] + 1)) if len(ref) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ref)) - 1 if len(first) else first
    return ref[first], place[first], place[last]


def _text_parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    yield from parts(offsets, data)


def pieces_of(rows: DataFrame) -> DataFrame:
    """anchor, digest, ref, first, strings: one row per piece."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ref = batch["ref"].to_numpy(zero_copy_only=False)
            for doc, begin, offsets, data in _text_parts(batch["text"]):
                anchor, first, count, digest = anchored(offsets, data)
                part = np.searchsorted(offsets, first, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)),
                        pa.array(digest.view(np.int64)),
                        pa.array(ref[doc[part]] if len(part) else np.zeros(0, np.int64)),
                        pa.array((first - offsets[part] + begin[part]).astype(np.int64)),
                        pa.array(count.astype(np.int32)),
                    ],
                    ["anchor", "digest", "ref", "first", "strings"],
                )

    return rows.select("ref", "text").mapInArrow(scan, "anchor long, digest long, ref long, first long, strings int")


def _cut_out(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, shard, split, ref, first, piece: bytes of the wanted pieces."""
    by_ref = wanted.groupBy("ref").agg(F.collect_list(F.struct("anchor", "shard", "split", "first", "strings")).alias("cuts"))
    test = sieve(wanted, "ref")
    met = rows.filter(test("ref")).select("ref", "text").join(by_ref, "ref")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for row in range(len(batch)):
                text, ref, cuts = texts[row].as_py(), batch["ref"][row].as_py(), batch["cuts"][row].as_py()
                yield pa.RecordBatch.from_pydict(
                    {
                        "anchor": [c["anchor"] for c in cuts],
                        "shard": pa.array([c["shard"] for c in cuts], pa.int32()),
                        "split": [c["split"] for c in cuts],
                        "ref": [ref] * len(cuts),
                        "first": [c["first"] for c in cuts],
                        "piece": pa.array([text[c["first"] : c["first"] + c["strings"] + LENGTH - 1] for c in cuts], pa.binary()),
                    }
                )

    return met.mapInArrow(cut, "anchor long, shard int, split boolean, ref long, first long, piece binary")


def _fingerprints(pieces: list[bytes], owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit numbers per string."""
    out = np.empty(len(owner), np.uint64), np.empty(len(owner), np.uint64)
    for i in range(len(owner)):
        digest = hashlib.blake2b(pieces[owner[i]][place[i] : place[i] + LENGTH], digest_size=16).digest()
        out[0][i], out[1][i] = np.frombuffer(digest, "<u8")
    return out


def _in_shards(cut: DataFrame) -> DataFrame:
    """anchor, ref, first, last, one, two: ranges of repeats found in a shard (one and two null), and for split anchors
    the strings to look up in the other shards, one per class."""

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        pieces = [h[5] for h in held]
        owner, place, classes = repeats(pieces)
        ref = np.array([h[3] for h in held])[owner]
        begin = np.array([h[4] for h in held])[owner] + place
        total = np.bincount(classes)
        again = total[classes] > 1
        r, low, high = _ranges(ref[again], begin[again])
        yield rows_of(np.zeros(len(r), np.int64), r, low, high, None)
        split = np.array([h[2] for h in held])[owner]
        first = np.append(True, classes[1:] != classes[:-1]) if len(classes) else np.zeros(0, bool)
        chosen = np.flatnonzero(split & first)
        if len(chosen):
            anchor = np.array([h[0] for h in held])[owner[chosen]]
            yield rows_of(anchor, ref[chosen], begin[chosen], begin[chosen], _fingerprints(pieces, owner[chosen], place[chosen]))

    def rows_of(anchor, ref, low, high, prints) -> pa.RecordBatch:
        none = pa.nulls(len(ref), pa.int64())
        one, two = (none, none) if prints is None else (pa.array(p.view(np.int64)) for p in prints)
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor, pa.int64()), pa.array(ref, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), one, two],
            ["anchor", "ref", "first", "last", "one", "two"],
        )

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                # A shard of an anchor stays whole; several small ones share a suffix array.
                if size >= SHARD_BYTES and row[:2] != last:
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = row[:2]
        if held:
            yield from solve(held)

    dealt = cut.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard")
    return dealt.mapInArrow(shards, "anchor long, ref long, first long, last long, one long, two long")


def _merged(strings: DataFrame) -> DataFrame:
    """ref, first, last: strings of split anchors that occur in more than one shard. A task owns ranges of fingerprints;
    the shards' runs that meet there are looked up in each other by binary search."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        one, two = (table[c].to_numpy().view(np.uint64) for c in ("one", "two"))
        ref, first = (table[c].to_numpy() for c in ("ref", "first"))
        order = np.lexsort((two, one))
        sorted_one = one[order]
        low = np.searchsorted(sorted_one, one, "left")
        high = np.searchsorted(sorted_one, one, "right")
        again = np.zeros(len(one), bool)
        for i in np.flatnonzero(high - low > 1):
            again[i] = (two[order[low[i] : high[i]]] == two[i]).sum() > 1
        r, a, b = _ranges(ref[again], first[again])
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(a), pa.array(b)], ["ref", "first", "last"])

    dealt = strings.select("ref", "first", "one", "two").repartition("one")
    return dealt.mapInArrow(merge, "ref long, first long, last long")


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """ref, first, last: places where a repeated string of LENGTH bytes starts, as ranges."""
    pieces = materialize(pieces_of(rows))
    seen = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    test = sieve(seen, "anchor")
    likely = materialize(pieces.filter(test("anchor")))
    place = F.struct("ref", "first", "strings")
    distinct = materialize(
        likely.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"))
    )
    # Equal pieces: all their strings repeat.
    equal = likely.join(distinct.filter("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi")
    whole = equal.select("ref", "first", (F.col("first") + F.col("strings") - 1).alias("last"))
    # Different pieces with one anchor: one copy of each goes to the anchor's shards.
    mixed = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    spread = F.ceil(F.col("kinds") / SHARD_PIECES)
    wanted = materialize(
        distinct.join(mixed, "anchor").select(
            "anchor",
            F.pmod("digest", spread).cast("int").alias("shard"),
            (spread > 1).alias("split"),
            "one.ref",
            "one.first",
            "one.strings",
        )
    )
    solved = materialize(_in_shards(_cut_out(rows, wanted)))
    inside = solved.filter("one is null").select("ref", "first", "last")
    across = _merged(solved.filter("one is not null"))
    return whole.unionByName(inside).unionByName(across)


def cover(size: int, ranges: list[dict]) -> np.ndarray:
    """Which bytes lie in a string that starts in one of the ranges."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, [r["first"] for r in ranges], 1)
    np.add.at(edge, np.minimum([r["last"] + LENGTH for r in ranges], size), -1)
    return np.cumsum(edge[:-1]) > 0


def _remove(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts.cast(pa.binary()).to_pylist(), ranges.to_pylist()):
        if text is None or not found:
            out.append(None)
            continue
        data = np.frombuffer(text, np.uint8)
        gone = cover(len(data), found)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append({"n_removed": int(gone.sum()), "n_spans": spans, "kept": data[~gone].tobytes()})
    return pa.array(out, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, null if all remain), sha256.

    Every byte in a string of LENGTH bytes that also starts anywhere else in the table is removed, judged on the texts
    as they are. Null texts count as empty; shorter texts keep all bytes. Repeated rows are documents of their own, so
    their strings repeat. Null ids stay; an empty table gives no rows; other columns are ignored. Pieces and strings of
    split anchors are compared by 128-bit fingerprints.
    """
    prepare(docs.sparkSession)
    rows = keyed(docs)
    ranges = materialize(repeated_ranges(rows))
    by_ref = ranges.groupBy("ref").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    test = sieve(ranges, "ref")
    body = F.col("text").cast("binary")
    narrow = rows.select(
        "ref", "doc_id", F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha256"), "text", test("ref").alias("likely")
    ).select("ref", "doc_id", "n_bytes", "sha256", F.when(F.col("likely"), F.col("text")).alias("text"))
    met = narrow.join(by_ref, "ref", "left")
    out = "struct<n_removed:bigint,n_spans:bigint,kept:binary>"
    cut = met.select("doc_id", "n_bytes", "sha256", F.arrow_udf(_remove, out)("text", "ranges").alias("r"))
    return cut.select(
        "doc_id",
        "n_bytes",
        F.coalesce("r.n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("r.n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.col("r.kept").alias("kept"),
        "sha256",
    )
