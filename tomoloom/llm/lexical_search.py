"""Ranked lexical search over an inverted index by Block-Max MaxScore.

Documents are dealt into shards of bounded size. A shard's postings are compressed in blocks of `BLOCK` documents; beside
each block lie its last document, its largest term frequency and its shortest document, which bound every score in it.
The index is one table and holds every document and term; corpus statistics are sums over it.

A search takes items in blocks. For each item the terms' largest scores over all shards (the global bounds) split its
lists: lists whose bounds together stay below the item's tenth score so far are not essential, as no document they
alone hold can enter. Documents of the essential lists are candidates. The other lists are asked in descending order of
bound, and a candidate is dropped as soon as its score, the bound of the block it would lie in and the bounds of the lists
to come stay below the tenth score; only blocks that a candidate is left for are decompressed. A task goes through many
shards and keeps one heap per item; the tasks' heaps are merged at the end.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomoloom.functions.storage import discard, materialize
from tomoloom.llm.common import prepare, span_ids, texts
from tomoloom.llm.common import LOWER
from tomoloom.llm.terms import IS_ALNUM, pieces, runs

#: Text bytes and documents of a shard; a longer text is a shard alone.
SHARD_BYTES = 8 << 20
SHARD_DOCS = 1 << 15
#: Documents of a compressed block.
BLOCK = 128
#: Documents returned for an item.
TOP = 10
#: Item-term pairs that one search job sends to every task; an item with more is a job alone.
PAIRS_PER_JOB = 1 << 17
#: Numbers of one task's shards and rows.
NUMBERS = 1 << 33

_IN_TERM = IS_ALNUM | (np.arange(256) >= 128)
_WIDTHS = np.array([1, 2, 4])
INDEX = (
    "shard long, term long, df int, last array<int>, most array<int>, least array<int>, at array<int>, data binary, "
    "doc_ids array<long>, lengths array<int>"
)


def _terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and 64-bit id of every term of a batch of texts, some at a time."""
    for row, offsets, data in pieces(column):
        low = LOWER[data]
        start, length, text = runs(_IN_TERM[low], offsets)
        yield text + row, span_ids(low, start, length).view(np.int64)


def _width(most: np.ndarray) -> np.ndarray:
    """Code of the bytes a number takes: 0, 1, 2 for one, two, four bytes."""
    return (most > 0xFF).astype(np.int64) + (most > 0xFFFF)


def _spread(values: np.ndarray, code: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Write values little-endian in their width to their places."""
    for byte in range(4):
        chosen = _WIDTHS[code] > byte
        out[at[chosen] + byte] = values[chosen] >> (8 * byte) & 0xFF


class Postings:
    """All lists of one shard, laid out as arrays."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray):
        """`term`, `doc`: sorted by both, without repeats."""
        self.first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        self.term = term[self.first]
        self.df = np.diff(np.append(self.first, len(term)))
        inside = np.arange(len(term)) - np.repeat(self.first, self.df)
        begin = np.flatnonzero(inside % BLOCK == 0)
        count = np.diff(np.append(begin, len(term)))
        self.blocks = -(-self.df // BLOCK)
        gap = np.diff(doc, prepend=0)
        gap[self.first] = doc[self.first] + 1
        if len(term):
            self.last = doc[begin + count - 1]
            self.most = np.maximum.reduceat(tf, begin)
            self.least = np.minimum.reduceat(lengths[doc], begin)
            gap_code, tf_code = _width(np.maximum.reduceat(gap, begin)), _width(self.most)
        else:
            self.last = self.most = self.least = gap_code = tf_code = np.zeros(0, np.int64)
        # A block: a byte for both widths, all gaps, all frequencies.
        size = 1 + count * (_WIDTHS[gap_code] + _WIDTHS[tf_code])
        place = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint8)
        out[place] = gap_code * 3 + tf_code
        order = np.arange(len(term)) - np.repeat(begin, count)
        gap_width = np.repeat(gap_code, count)
        gaps_at = np.repeat(place + 1, count) + order * _WIDTHS[gap_width]
        _spread(gap, gap_width, gaps_at, out)
        tf_width = np.repeat(tf_code, count)
        tfs_at = np.repeat(place + 1 + count * _WIDTHS[gap_code], count) + order * _WIDTHS[tf_width]
        _spread(tf, tf_width, tfs_at, out)
        self.data = out
        self.list_block = np.cumsum(self.blocks) - self.blocks
        self.list_byte = place[self.list_block] if len(term) else np.zeros(0, np.int64)
        self.at = place - np.repeat(self.list_byte, self.blocks)

    def rows(self, shard: int, chunk: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        ends = np.append(self.list_byte, len(self.data))
        cuts = np.append(self.list_block, len(self.last))
        for low in range(0, len(self.term), chunk):
            high = min(low + chunk, len(self.term))
            n = high - low
            span = slice(cuts[low], cuts[high])
            offsets = pa.array((cuts[low : high + 1] - cuts[low]).astype(np.int32))

            def lists(values: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(offsets, pa.array(values[span].astype(np.int32)))

            raw = pa.py_buffer((ends[low : high + 1] - ends[low]).astype(np.int32))
            data = pa.py_buffer(self.data[ends[low] : ends[high]])
            none = pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, shard)),
                    pa.array(self.term[low:high]),
                    pa.array(self.df[low:high].astype(np.int32)),
                    *map(lists, (self.last, self.most, self.least, self.at)),
                    pa.Array.from_buffers(pa.binary(), n, [None, raw, data]),
                    *none,
                ],
                _NAMES,
            )


_NAMES = [part.split()[0] for part in INDEX.split(", ")]


def decode(data: bytes, at: int, count: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and frequencies of one block; `before` is the last document of the block before, or -1."""
    gap_code, tf_code = divmod(data[at], 3)
    kinds = ("<u1", "<u2", "<u4")
    gaps = np.frombuffer(data, kinds[gap_code], count, at + 1)
    tf = np.frombuffer(data, kinds[tf_code], count, at + 1 + count * int(_WIDTHS[gap_code]))
    return np.cumsum(gaps, dtype=np.int64) + before, tf.astype(np.int64)


class Shard:
    """Collects documents until the shard is full."""

    def __init__(self):
        self.ids: list = []
        self.lengths: list[np.ndarray] = []
        self.docs, self.terms, self.counts, self.bytes = [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        base, lengths = len(self.ids), np.zeros(len(batch), np.int64)
        for row, term in _terms(batch["text"]):
            lengths += np.bincount(row, minlength=len(batch))
            kind, distinct = pd.factorize(term)
            pair, count = np.unique(kind * len(batch) + row, return_counts=True)
            self.docs.append(base + pair % len(batch))
            self.terms.append(distinct[pair // len(batch)])
            self.counts.append(count)
        self.ids += batch["doc_id"].to_pylist()
        self.lengths.append(lengths)
        self.bytes += batch["text"].nbytes

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        lengths = np.concatenate(self.lengths)
        term = np.concatenate([np.zeros(0, np.int64), *self.terms])
        doc = np.concatenate([np.zeros(0, np.int64), *self.docs])
        # Terms in the order of their ids; a long text may have added to one of them more than once.
        kind, distinct = pd.factorize(term)
        place = np.empty(len(distinct), np.int64)
        place[np.argsort(distinct)] = np.arange(len(distinct))
        key = place[kind] * len(self.ids) + doc
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        tf = np.add.reduceat(np.concatenate(self.counts)[order], first) if len(key) else first
        sorted_terms = np.sort(distinct)
        key = key[first]
        postings = Postings(sorted_terms[key // len(self.ids)], key % len(self.ids), tf, lengths)
        yield pa.RecordBatch.from_pylist(
            [{"shard": number, "doc_ids": self.ids, "lengths": lengths.tolist()}], schema=_SCHEMA
        )
        yield from postings.rows(number)


_INTS = pa.list_(pa.int32())
_SCHEMA = pa.schema(
    zip(_NAMES, [pa.int64(), pa.int64(), pa.int32(), _INTS, _INTS, _INTS, _INTS, pa.binary(), pa.list_(pa.int64()), _INTS])
)


def _build_task(shard_bytes: int, shard_docs: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, shard = TaskContext.get().partitionId() * NUMBERS, Shard()
        for batch in batches:
            shard.add(batch)
            if shard.bytes >= shard_bytes or len(shard.ids) >= shard_docs:
                yield from shard.rows(number)
                number, shard = number + 1, Shard()
        if shard.ids:
            yield from shard.rows(number)

    return build


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of all documents, written: a row per shard with its documents, and a row per shard and term."""
    prepare(docs.sparkSession)
    return materialize(texts(docs).mapInArrow(_build_task(shard_bytes, shard_docs), INDEX))


def _impact(tf, n, docs: int, terms: int):
    """A term's score in a document without its weight; integers, columns or arrays."""
    if isinstance(tf, Column):
        m = F.lit(10).cast("bigint") + F.call_function("div", F.lit(90 * docs).cast("bigint") * n, F.lit(terms).cast("bigint"))
        return F.call_function("div", F.lit(10**9) * tf.cast("bigint"), F.lit(1000) * tf.cast("bigint") + F.lit(8) * m)
    m = 10 + 90 * docs * n // terms
    return 10**9 * tf // (1000 * tf + 8 * m)


class List:
    """One term's list in one shard; blocks are decompressed when asked for and then kept with the shard."""

    def __init__(self, row: dict, lengths: np.ndarray, docs: int, terms: int):
        self.df, self.data = row["df"], row["data"]
        self.last = np.array(row["last"], np.int64)
        self.at = row["at"]
        self.bounds = _impact(np.array(row["most"], np.int64), np.array(row["least"], np.int64), docs, terms)
        self.bound = int(self.bounds.max())
        self.score = lambda doc, tf: _impact(tf, lengths[doc], docs, terms)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and their scores without the weight."""
        found = self.open.get(k)
        if found is None:
            count = min(BLOCK, self.df - k * BLOCK)
            doc, tf = decode(self.data, self.at[k], count, int(self.last[k - 1]) if k else -1)
            found = self.open[k] = doc, self.score(doc, tf)
        return found

    def blocks(self, which) -> tuple[np.ndarray, np.ndarray]:
        found = [self.block(k) for k in which]
        return (found[0] if len(found) == 1 else tuple(np.concatenate(part) for part in zip(*found)))


class Searcher:
    """Heaps of all items of a job over the shards of a task."""

    def __init__(self, items: dict, docs: int, terms: int, top: int):
        """`items`: key to its (term, weight, global bound of the weighted score), largest bound first."""
        self.items, self.docs, self.terms, self.top = items, docs, terms, top
        self.heaps: dict = {key: [] for key in items}
        self.opened = self.held = 0

    def shard(self, doc_ids: list, lengths: np.ndarray, rows: dict) -> None:
        lists = {t: List(row, lengths, self.docs, self.terms) for t, row in rows.items()}
        for key, terms in self.items.items():
            here = [(lists[t], w, bound) for t, w, bound in terms if t in lists]
            if here:
                self._item(key, here, doc_ids)
        self.opened += sum(len(x.open) for x in lists.values())
        self.held += sum(len(x.last) for x in lists.values())

    def _item(self, key, lists: list, doc_ids: list) -> None:
        heap = self.heaps[key]
        # Scores below it cannot enter; an equal one may, by its doc_id.
        floor = heap[-1][0] if len(heap) == self.top else 1
        if sum(w * x.bound for x, w, _ in lists) < floor:
            return
        # Non-essential lists: their global bounds together stay below the floor.
        essential, rest = len(lists), 0
        while essential and rest + lists[essential - 1][2] < floor:
            essential -= 1
            rest += lists[essential][2]
        score = np.zeros(len(doc_ids), np.int64)
        for x, w, _ in lists[:essential]:
            doc, impact = x.blocks(range(len(x.last)))
            score[doc] += w * impact
        doc = np.flatnonzero(score)
        score = score[doc]
        left = [w * x.bound for x, w, _ in lists[essential:]]
        coming = sum(left)
        for (x, w, _), bound in zip(lists[essential:], left):
            coming -= bound
            block = np.searchsorted(x.last, doc)
            inside = block < len(x.last)
            most = np.where(inside, w * x.bounds[np.minimum(block, len(x.last) - 1)], 0)
            kept = score + most + coming >= floor
            doc, score, block, inside = doc[kept], score[kept], block[kept], inside[kept]
            if not len(doc):
                return
            wanted = np.unique(block[inside])
            if len(wanted):
                there, impact = x.blocks(wanted.tolist())
                at = np.minimum(np.searchsorted(there, doc), len(there) - 1)
                score = score + np.where(there[at] == doc, w * impact[at], 0)
        kept = score >= floor
        doc, score = doc[kept], score[kept]
        if len(doc) > self.top:
            # All that may be among the first, equal scores included.
            tenth = np.partition(score, -self.top)[-self.top]
            doc, score = doc[score >= tenth], score[score >= tenth]
        for d, s in zip(doc.tolist(), score.tolist()):
            heap.append((s, doc_ids[d]))
        heap.sort(key=_rank)
        del heap[self.top :]


def _rank(entry: tuple) -> tuple:
    """Best first: the score, then the smaller id, rows without an id last."""
    score, doc_id = entry
    return -score, doc_id is None, doc_id or 0


def _search_task(items, docs: int, terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(items.value, docs, terms, top)
        current, held, rows = None, None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != current:
                    if held:
                        searcher.shard(*held, rows)
                    current, held, rows = row["shard"], None, {}
                if row["term"] is None:
                    held = row["doc_ids"], np.array(row["lengths"], np.int64)
                else:
                    rows[row["term"]] = row
        if held:
            searcher.shard(*held, rows)
        found = [(*key, doc, score) for key, heap in searcher.heaps.items() for score, doc in heap]
        if found:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*found), kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

    return run


def _item_terms(items: DataFrame) -> DataFrame:
    """item (a number per row), item_id, term: the distinct terms of each item, written."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, term in _terms(batch["text"]):
                pair = pd.DataFrame({"row": row, "term": term}).drop_duplicates()
                at = pa.array(pair["row"].to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [batch["item"].take(at), batch["item_id"].take(at), pa.array(pair["term"].to_numpy())],
                    ["item", "item_id", "term"],
                )

    numbered = materialize(
        items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("item", F.monotonically_increasing_id())
    )
    return materialize(numbered.mapInArrow(split, "item long, item_id long, term long").distinct())


def _weight(docs: int):
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("bigint")


def search_index(index: DataFrame, items: DataFrame, top: int = TOP, pairs_per_job: int = PAIRS_PER_JOB) -> DataFrame:
    """`top` documents of a written index for each row of `items`; see `ranked`."""
    spark = index.sparkSession
    prepare(spark)
    shards = index.filter("term is null")
    total = shards.agg(
        F.sum(F.size(F.filter("lengths", lambda n: n > 0))).alias("docs"),
        F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n)).alias("terms"),
    ).first()
    docs, terms = int(total.docs or 0), int(total.terms or 0)
    pairs = _item_terms(items)
    jobs = max(1, math.ceil(pairs.count() / pairs_per_job))
    empty = spark.createDataFrame([], "item long, item_id long, doc_id long, score long")
    if not docs:
        return empty.select("item_id", F.lit(1).alias("rank"), "doc_id", "score")
    asked = materialize(pairs.select("term").distinct())
    lists = index.filter("term is not null")
    bound = F.array_max(F.zip_with("most", "least", lambda tf, n: _impact(tf, n, docs, terms)))
    known = materialize(
        lists.join(asked, "term", "left_semi")
        .groupBy("term")
        .agg(F.sum("df").alias("df"), F.max(bound).alias("bound"))
        .select("term", _weight(docs).alias("w"), "bound")
    )
    weighted = pairs.join(known, "term").select("item", "item_id", "term", "w", (F.col("w") * F.col("bound")).alias("bound"))
    weighted = materialize(weighted.filter("w > 0").withColumn("job", F.pmod(F.xxhash64("item"), F.lit(jobs))))
    discard(asked)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    heaps = []
    for job in range(jobs):
        mine = weighted.filter(F.col("job") == job)
        chosen = defaultdict(list)
        # One job's pairs: about `pairs_per_job` of them.
        for r in mine.select("item", "item_id", "term", "w", "bound").collect():
            chosen[r.item, r.item_id].append((r.term, r.w, r.bound))
        if not chosen:
            continue
        for entry in chosen.values():
            entry.sort(key=lambda t: (-t[2], t[0]))
        held = spark.sparkContext.broadcast(dict(chosen))
        wanted = lists.join(materialize(mine.select("term").distinct()), "term", "left_semi").select(*_NAMES)
        dealt = shards.select(*_NAMES).unionByName(wanted).repartition(parts, "shard").sortWithinPartitions("shard")
        heaps.append(
            materialize(dealt.mapInArrow(_search_task(held, docs, terms, top), "item long, item_id long, doc_id long, score long"))
        )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = reduce(DataFrame.unionByName, heaps, empty).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents with a score above 0 for each item, all if there are fewer.

    A null or empty text, or one without a term, is found by nothing and finds nothing. Each row is a document and each
    row of `items` an item, also where ids repeat; equal scores go by ascending doc_id, rows without an id last. Very
    long texts are read in pieces. Empty tables give no rows. Other columns are ignored.
    """
    return search_index(build_index(docs), items, top)
