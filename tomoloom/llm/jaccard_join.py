"""Near-duplicate classes by a Jaccard join on word shingles, with token-combination prefixes.

Shingles are tokens. A small sketch of all shingle counts orders them, rare ones first, and calls those far above the
sketch's noise frequent. Of each set only a prefix is indexed: a rare token by itself, a frequent one only in pairs of
frequent tokens of one subclass. A pair needs two shared tokens, so the prefix is extended until the tokens that a
linked partner may lack cannot spoil every entry:

    rare tokens + sum over subclasses of (tokens - 1)  >=  tokens of the set that a partner may lack + extra.

Then two linked sets share an entry of two tokens, or `extra` rare tokens at least (those of the set whose prefix ends
first), whatever the counts were. Subclasses
are sized by the set's length, rounded to levels a third apart; linked sets lie in the same or neighbouring levels, so
each set is indexed for its own level and the next.

Entries with one set are dropped, and so are sets that keep neither an entry of two tokens nor `fewest` rare ones. In the
entries left, sets are compared with one leader at a time: links join sets into components, and later rounds take other
leaders and only those sets that are not yet in the leader's component. What is left after the rounds, different
components that meet in an entry, is compared in full, so no link is lost. Of those that meet in pairs of frequent tokens,
as all texts around a very common passage do, sets are compared only where their tokens of their own and the parity of
their tokens' bits leave a link possible. Comparing is exact, on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomoloom.functions.storage import discard, materialize
from tomoloom.llm.common import keyed, mix, prepare, sieve, sieve_cell, sieve_table, text_blocks, unused, with_key, words
from tomoloom.llm.components import components

WORDS = 5
CELLS = 1 << 17
#: A token is frequent if its cell holds so many times the mean, and at least so many.
ABOVE_MEAN, AT_LEAST = 4, 256
#: Sets that one part of a frequent entry holds, about.
PART = 4096
ROUNDS = 5
#: Bits of the sieve of entries that several sets have.
ENTRY_BITS = 26
#: Bits of a set's parity, and the 64-bit words that hold them.
PARITY_BITS = 1024
PARITY_WORDS = PARITY_BITS // 64
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; with fewer words, the whole sequence is the one shingle."""
    ids, doc = words(data, offsets)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    if len(ids) >= size:
        joined = ids[: len(ids) - size + 1] * _ODD[0]
        for k in range(1, size):
            joined = mix(joined ^ (ids[k : len(ids) - size + 1 + k] * _ODD[k]))
    out = []
    for low, high in zip(first.tolist(), first[1:].tolist()):
        if high - low >= size:
            out.append(np.unique(joined[low : high - size + 1]))
        elif high > low:
            short = np.full(1, high - low, np.uint64)
            for k in range(low, high):
                short = mix(short ^ (ids[k : k + 1] * _ODD[4]))
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def spare(size: np.ndarray | int):
    """Tokens of a set that a linked partner may lack: 100 * common >= 75 * union >= 75 * size."""
    return size - -(-3 * size // 4)


def extra(size: int) -> int:
    """Tokens by which a prefix is longer than the least one: so many rare tokens it shares with a linked set's prefix
    that reaches at least as far, if they share no frequent pair."""
    return 1 + spare(size) // 3


def fewest(size: int) -> int:
    """Rare tokens that a set shares at least with any linked set, which may be a quarter smaller."""
    return extra(-(-3 * size // 4))


def shared_least(n_a: str, n_b: str) -> str:
    """SQL: rare tokens that the prefixes of two linked sets of these sizes share at least, if they share no frequent pair.

    Linked sets have 3/7 of their summed sizes in common or more, so either may lack so few of its tokens; the prefix that
    ends first holds `spare + extra` tokens, all others of which are in the partner's prefix too.
    """
    common = f"((3L * ({n_a} + {n_b}) + 6) div 7)"
    spared = {n: f"({n} - (3L * {n} + 3) div 4)" for n in (n_a, n_b)}
    return "least(" + ", ".join(f"{spared[n]} + 1 + {spared[n]} div 3 - {n} + {common}" for n in (n_a, n_b)) + ")"


def parity(tokens: np.ndarray) -> np.ndarray:
    """Per bit, whether an odd number of tokens falls on it. Two sets differ in as many tokens at least as their bits do."""
    odd = np.bincount((tokens >> np.uint64(54)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return 100 * common >= 75 * (len(a) + len(b) - common)


def level_of(size: int) -> int:
    """Whole powers of 4/3 below the size, in exact arithmetic: linked sets differ by one level at most."""
    level, top, bottom = 0, 4, 3
    while top <= size * bottom:
        level, top, bottom = level + 1, top * 4, bottom * 3
    return level


def subclasses(level: int) -> int:
    return max(1, int((4 / 3) ** level / 8))


def entries(tokens: np.ndarray, counts: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set; for frequent pairs the number of parts that their sets are dealt to, 0 for rare tokens."""
    size = len(tokens)
    if size <= 1:
        return tokens, np.zeros(size, np.int64)
    need = spare(size) + extra(size)
    held = counts[(tokens & np.uint64(CELLS - 1)).astype(np.int64)]
    frequent = held > max(ABOVE_MEAN * mean, AT_LEAST)
    rank = np.minimum((held / (mean + 1)).astype(np.int64), 1 << 20)
    order = np.lexsort((tokens, rank, frequent))
    tokens, held, rare = tokens[order], held[order], int(size - frequent.sum())
    single = tokens[: min(rare, need)]
    keys, parts = [single], [np.zeros(len(single), np.int64)]
    if rare < need:
        common, seen = tokens[rare:], held[rare:]
        own = level_of(size)
        for level in (own, own + 1):
            count = subclasses(level)
            group = (common >> np.uint64(20)).astype(np.int64) % count
            # Every token but the first of its subclass counts.
            first = np.zeros(len(common), bool)
            first[np.unique(group, return_index=True)[1]] = True
            gained = np.cumsum(~first)
            stop = int(np.searchsorted(gained, need - rare)) + 1
            by = np.argsort(group[:stop], kind="stable")
            one, other = _pairs(group[:stop][by])
            one, other = by[one], by[other]
            low, high = np.minimum(one, other), np.maximum(one, other)
            keys.append(mix(common[low] * _ODD[1] ^ mix(common[high] * _ODD[2] ^ np.uint64(level + 1))))
            parts.append(1 + np.minimum(seen[low], seen[high]) // PART)
    return np.concatenate(keys), np.concatenate(parts)


def _pairs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within runs of equal numbers."""
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    run = np.diff(np.append(start, len(group)))
    end = np.repeat(start + run, run)
    later = end - np.arange(len(group)) - 1
    one = np.repeat(np.arange(len(group)), later)
    other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(later) - later, later)
    return one, other


def _sketch(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Number of set members per cell, and the mean of all cells."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, offsets, data in text_blocks(batch["text"]):
                for tokens in shingle_sets(data, offsets):
                    cells += np.bincount((tokens & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) if len(tokens) > CELLS else 0
                    if len(tokens) <= CELLS:
                        np.add.at(cells, (tokens & np.uint64(CELLS - 1)).astype(np.int64), 1)
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(cells[used])], ["cell", "n"])

    found = rows.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CELLS, np.int64)
    counts[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts, counts.sum() / CELLS


def _indexed(rows: DataFrame, counts: np.ndarray, mean: float) -> DataFrame:
    """ref, doc_id, n, two 64-bit digests of the set, its parity, and its index entries with their part."""
    held = rows.sparkSession.sparkContext.broadcast(counts)  # CELLS numbers

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for batch in batches:
            ref = batch["ref"].to_numpy(zero_copy_only=False)
            for row, offsets, data in text_blocks(batch["text"]):
                sizes, needs, one, two, odd, keys, parts = [], [], [], [], [], [], []
                for i, tokens in enumerate(shingle_sets(data, offsets)):
                    sizes.append(len(tokens))
                    needs.append(fewest(len(tokens)))
                    one.append(int(mix(tokens ^ _ODD[2]).sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(mix(tokens ^ _ODD[3]).sum(dtype=np.uint64).view(np.int64)))
                    odd.append(parity(tokens))
                    key, part = entries(tokens, counts, mean)
                    own = int(mix(np.array([ref[row + i]], np.int64).view(np.uint64) ^ _ODD[0])[0] >> np.uint64(8))
                    keys.append(key.view(np.int64))
                    parts.append(np.where(part > 0, own % np.maximum(part, 1), -1).astype(np.int32))
                ends = np.cumsum([0, *(len(k) for k in keys)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x))) for x in (keys, parts)]
                part = batch.slice(row, len(sizes))
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(odd) + 1, dtype=np.int32) * PARITY_WORDS), pa.array(np.concatenate(odd)))
                yield pa.RecordBatch.from_arrays(
                    [part["ref"], part["doc_id"], pa.array(sizes, pa.int32()), pa.array(needs, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), bits, *lists],
                    ["ref", "doc_id", "n", "need", "one", "two", "parity", "entry", "part"],
                )

    return rows.mapInArrow(
        index, "ref long, doc_id long, n int, need int, one long, two long, parity array<long>, entry array<long>, part array<int>"
    )


def _sharing(index: DataFrame) -> DataFrame:
    """ref, n, need, entry, part, central of the sets that can have a partner, with those of their entries that others
    have too. `central` is how many sets share the set's entries, so it is largest in the middle of a group."""

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("entry").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")

    def kept(rows: DataFrame, table: np.ndarray, bits: int) -> DataFrame:
        """Without entries that fail the sieve, and without sets that have too few left."""
        held = rows.sparkSession.sparkContext.broadcast(table)
        shared = F.arrow_udf(_passes(held), "array<boolean>")(F.transform("entry", lambda e: sieve_cell(e, bits)))
        zipped = F.filter(F.arrays_zip("entry", "part", shared.alias("shared")), lambda e: e["shared"])
        lone = F.size(F.filter("e", lambda e: e["part"] < 0))
        return rows.select("ref", "n", "need", zipped.alias("e")).filter((lone >= F.col("need")) | (F.size("e") > lone))

    first = kept(index.select("ref", "n", "need", "entry", "part"), sieve_table(counted(index.select(F.explode("entry").alias("entry"))), "entry", ENTRY_BITS), ENTRY_BITS)
    left = materialize(first.select("ref", "n", "need", F.explode("e").alias("e")).select("ref", "n", "need", "e.entry", "e.part"))
    shared = left.join(counted(left), "entry")
    # Once more, exactly: entries that others have too, of sets that keep enough of them.
    lone = F.count_if(F.col("part") < 0)
    enough = materialize(shared)
    refs = enough.groupBy("ref").agg((lone >= F.first("need")).alias("rare"), (F.count(F.lit(1)) > lone).alias("pair"), F.sum("many").alias("central"))
    refs = refs.filter("rare or pair").select("ref", "central")
    out = materialize(enough.drop("many").join(refs, "ref"))
    discard(left)
    discard(enough)
    return out


def _passes(held: Broadcast):
    def passes(cells: pa.Array) -> pa.Array:
        flat = cells.flatten().to_numpy(zero_copy_only=False)
        found = pa.array((held.value[flat >> 6] >> (flat & 63) & 1) == 1)
        ends = np.cumsum(np.append(0, pc.list_value_length(cells).to_numpy(zero_copy_only=False))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), found)

    return passes


def _linked(one: pa.Array, other: pa.Array) -> pa.Array:
    def sets(column: pa.Array) -> list[np.ndarray]:
        return [t for _, offsets, data in text_blocks(column) for t in shingle_sets(data, offsets)]

    return pa.array([linked(a, b) for a, b in zip(sets(one), sets(other))], pa.bool_())


def _compared(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """a, b, linked: both whole texts of a pair meet."""
    refs = pairs.select(F.col("a").alias("ref")).unionByName(pairs.select(F.col("b").alias("ref")))
    near = bodies.filter(sieve(refs, "ref")("ref"))
    with_b = pairs.join(near.select(F.col("ref").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(near.select(F.col("ref").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", F.arrow_udf(_linked, "boolean")("text_a", "text_b").alias("linked"))


def _ordered(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


FITS = "4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)"


def _enough(met: DataFrame) -> DataFrame:
    """a, b of the pairs (x, n_a, y, n_b, part, one row per entry) that can be links: of fitting size,
    with a frequent pair or as many rare tokens in common as linked sets of these sizes have."""
    counted = (
        met.filter(FITS)
        .groupBy(*_ordered("x", "y"))
        .agg(
            F.count_if(F.col("part") < 0).alias("rare"),
            F.count_if(F.col("part") >= 0).alias("pairs"),
            F.max(F.expr(shared_least("n_a", "n_b"))).alias("need"),
        )
    )
    return counted.filter("pairs > 0 or rare >= need").select("a", "b")


def _leader_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of a set and the leader of its part of an entry, then of the parts' leaders and the entry's leader.

    The first leaders are the most central sets, later ones central sets drawn by hash. A pair that meets its leader in
    too few entries waits for a later round.
    """
    drawn = F.lit(1.0) if turn == 0 else 0.5 + F.pmod(F.xxhash64("ref", F.lit(turn)), F.lit(1 << 20)) / (1 << 20)
    best = F.max(F.struct((F.col("central") * drawn).alias("w"), F.col("ref"), F.col("n"), F.col("comp"), F.col("central"))).alias("top")
    leaders = members.groupBy("entry", "part").agg(best)
    chosen = leaders.select("entry", "part", "top.*")
    top = chosen.groupBy("entry").agg(best)

    def against(rows: DataFrame, tops: DataFrame, keys: list[str]) -> DataFrame:
        met = rows.join(tops, keys).filter(F.col("comp") != F.col("top.comp"))
        return met.select(
            F.col("ref").alias("x"), F.col("n").alias("n_a"), "part", F.col("top.ref").alias("y"), F.col("top.n").alias("n_b"),
        )

    lower = against(members, leaders, ["entry", "part"])
    upper = against(chosen.filter("part > 0"), top, ["entry"])
    return _enough(lower.unionByName(upper))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of the entries in which different components meet."""
    both = rows.groupBy("entry").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    return rows.join(both.select("entry"), "entry", "left_semi")


def _open(members: DataFrame) -> DataFrame:
    """Rows that can still lead to a link between components: those of mixed entries, of sets that keep enough of these.

    Linked sets share an entry of two tokens or `need` rare ones, all of them mixed until a link joins the sets. Components
    only grow, so what is left out here is of no use in later rounds either.
    """
    mixed = _mixed(members)
    of = Window.partitionBy("ref")
    lone = F.count_if(F.col("part") < 0).over(of)
    counted = mixed.withColumns({"lone": lone, "all": F.count(F.lit(1)).over(of)})
    return counted.filter("lone >= need or all > lone").drop("lone", "all")


def _rest(members: DataFrame, traits: DataFrame | None = None) -> DataFrame:
    """Pairs of sets of different components that may be links. traits: ref, rare (its rare entries, shared or not), parity.

    Of a set's rare entries, the last and most common ones of the order are no meeting points: sets that share so few rare
    entries are no links. What meets is counted over all of them.
    """
    rare = _mixed(members.filter("part < 0")).select("entry", "ref", "n", "need", "comp")
    # Linked sets share `least` of these, so one at least is not among the `least - 1` of either that most sets have.
    of, rising = Window.partitionBy("ref"), [F.col("many"), F.col("entry")]
    placed = rare.join(rare.groupBy("entry").agg(F.count(F.lit(1)).alias("many")), "entry").select(
        "entry", "ref", "n", "need", "comp", F.row_number().over(of.orderBy(*rising)).alias("at"), F.count(F.lit(1)).over(of).alias("all")
    )
    placed = materialize(placed.filter(F.col("all") >= F.col("need")))
    ones = placed.filter(F.col("at") <= F.col("all") - F.col("need") + 1)
    one, other = (
        ones.select("entry", F.col("ref").alias(r), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "comp", "at", "all")))
        for k, r in (("a", "x"), ("b", "y"))
    )
    least = shared_least("n_a", "n_b")
    # At most so many can be shared where two sets meet: those before it, itself and those behind it.
    early = f"least(all_a - at_a, all_b - at_b) + 1 >= {least}"
    met = one.join(other, "entry").filter("x < y and comp_a <> comp_b").filter(FITS).filter(early)
    met = materialize(met.select("x", "y", F.expr(least).alias("need")).distinct())
    lists = placed.groupBy("ref").agg(F.collect_list("entry").alias("held"))
    near = lists.join(met.select(F.explode(F.array("x", "y")).alias("ref")).distinct(), "ref", "left_semi")
    both = met.join(near.select(F.col("ref").alias("x"), F.col("held").alias("one")), "x")
    both = both.join(near.select(F.col("ref").alias("y"), F.col("held").alias("other")), "y")
    counted = both.filter(F.size(F.array_intersect("one", "other")) >= F.col("need")).select(*_ordered("x", "y"))
    return counted.unionByName(_rest_of_frequent(members, traits)).distinct()


def _near_enough(one: str, other: str, sizes: tuple[str, str], most: tuple[str, str]) -> str:
    """SQL: whether two sets can be linked. Linked sets have 3/7 of their summed sizes in common, so `most`, what either can
    share with the other, holds as many, and they differ in 1/7 at most. A null parity leaves the second open."""
    differ = " + ".join(f"bit_count({one}[{k}] ^ {other}[{k}])" for k in range(PARITY_WORDS))
    total = f"(0L + {sizes[0]} + {sizes[1]})"
    return f"7L * least({most[0]}, {most[1]}) >= 3L * {total} and coalesce(7L * ({differ}) <= {total}, true)"


def _rest_of_frequent(members: DataFrame, traits: DataFrame | None) -> DataFrame:
    """Pairs of sets of different components that meet in an entry of two frequent tokens and may be links.

    Near copies have such entries in great number, so each pair of components is taken once. A set with such entries has all
    its rare tokens in the index. Those of them that meet no other component among these sets, it shares with none of them.
    """
    deep = members.filter("part >= 0")
    sets = deep.select("ref", "n", "comp").distinct()
    if traits is None:
        sets = sets.select("*", F.col("n").alias("most"), F.lit(None).cast("array<long>").alias("parity"))
    else:
        met = _mixed(members.filter("part < 0").join(sets.select("ref"), "ref", "left_semi")).groupBy("ref").agg(F.count(F.lit(1)).alias("met"))
        known = sets.join(traits.select("ref", "rare", "parity"), "ref").join(met, "ref", "left")
        most = F.col("n") - F.col("rare") + F.coalesce("met", F.lit(0))
        sets = known.select("ref", "n", "comp", most.alias("most"), "parity").filter("4L * most >= 3L * n")
    sets = materialize(sets)
    # What holds for all sets of a component; a component of one set has its parity.
    whole = materialize(
        sets.groupBy("comp").agg(
            F.count(F.lit(1)).alias("sets"),
            F.min("n").alias("n"),
            F.max("most").alias("most"),
            F.when(F.count(F.lit(1)) == 1, F.first("parity")).alias("parity"),
        )
    )
    groups = _mixed(deep.join(sets.select("ref"), "ref", "left_semi").select("entry", "comp").distinct()).join(whole, "comp")
    groups = materialize(groups)
    one, other = (groups.select("entry", *(F.col(c).alias(f"{c}_{k}") for c in whole.columns)) for k in "ab")
    able = _near_enough("parity_a", "parity_b", ("n_a", "n_b"), ("most_a", "most_b"))
    meet = one.join(other, "entry").filter("comp_a < comp_b").filter(able).select("comp_a", "comp_b", "sets_a", "sets_b").distinct()
    # First the sets of the smaller component, so that no row is made for each of the larger one's before they are compared.
    pairs = meet.selectExpr(
        "if(sets_a <= sets_b, comp_a, comp_b) as small", "if(sets_a <= sets_b, comp_b, comp_a) as large"
    )
    x, y = (sets.select(F.col("comp").alias(c), *(F.col(v).alias(f"{v}_{k}") for v in ("ref", "n", "most", "parity"))) for k, c in (("a", "small"), ("b", "large")))
    both = pairs.join(x, "small").join(y, "large").filter(able)
    return both.select(*_ordered("ref_a", "ref_b"))


def _links(rows: DataFrame, postings: DataFrame, traits: DataFrame) -> DataFrame:
    """a, b: links that connect all sets of a component. traits as in `_rest`."""
    test = sieve(postings, "ref")
    bodies = materialize(rows.select("ref", "text").filter(test("ref")))
    spark = rows.sparkSession
    done = spark.createDataFrame([], "a long, b long, linked boolean")
    comp = spark.createDataFrame([], "node long, comp long")
    turn, found, rows_left = 0, True, 0
    while True:
        members = postings.join(comp.withColumnRenamed("node", "ref"), "ref", "left").select(
            "entry", "part", "ref", "n", "need", "central", F.coalesce("comp", "ref").alias("comp")
        )
        members = materialize(members)
        if turn:
            whole, members = members, materialize(_open(members))
            discard(whole)
        discard(postings)
        postings = members.drop("comp")
        before, rows_left = rows_left, members.count()
        if not rows_left:
            break
        # Where leaders have led to no link, or left nine tenths of the rows, others would do little: what is left is compared.
        last = turn == ROUNDS or not found or (turn > 1 and 10 * rows_left > 9 * before)
        pairs = _rest(members, traits) if last else _leader_pairs(members, turn)
        fresh = materialize(pairs.join(done.select("a", "b"), ["a", "b"], "left_anti"))
        found = False
        if not fresh.isEmpty():
            new = materialize(_compared(fresh, bodies))
            found = not new.filter("linked").isEmpty()
            whole, done = done, materialize(done.unionByName(new))
            discard(whole)
            discard(new)
        discard(fresh)
        if found:
            comp = components(done.filter("linked").select("a", "b"))
        if last:
            break
        turn += 1
    discard(postings)
    return done.filter("linked").select("a", "b")


def classes(rows: DataFrame) -> DataFrame:
    """ref, doc_id, n_shingles, component_id, stays (one row of each class). rows: ref (a number of its own), doc_id, text.

    Equal sets are one node of the join: the one with the smallest ref stands for them.
    """
    prepare(rows.sparkSession)
    counts, mean = _sketch(rows)
    index = materialize(_indexed(rows, counts, mean))
    heads = materialize(index.select("ref", "doc_id", "n", "one", "two"))
    nodes = materialize(
        heads.filter("n > 0").groupBy("n", "one", "two").agg(F.min("ref").alias("node"), F.min("doc_id").alias("smallest"))
    )
    # Copies that the sieve lets pass are compared like any other text.
    standing = index.filter(sieve(nodes.select(F.col("node").alias("ref")), "ref")("ref"))
    traits = index.select("ref", F.size(F.filter("part", lambda p: p < 0)).alias("rare"), "parity")
    links = _links(rows, _sharing(standing), traits)
    discard(index)
    comp = components(links)
    smallest = nodes.join(comp, "node", "left").select("node", "n", "one", "two", "smallest", F.coalesce("comp", "node").alias("comp"))
    smallest = materialize(smallest)
    by_comp = smallest.groupBy("comp").agg(F.min("smallest").alias("component_id"), F.min("node").alias("first"))
    named = smallest.join(by_comp, "comp").select("n", "one", "two", "component_id", "first")
    found = heads.join(named, ["n", "one", "two"], "left")
    return found.select(
        "ref",
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.col("first").isNull() | (F.col("first") == F.col("ref"))).alias("stays"),
    )


def shingle_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Null texts, empty ones and ones without words have no shingle and link with nothing. Repeated rows each give a row;
    a null id is never the smallest unless its component has no other. An empty table gives no rows; other columns are
    ignored. Shingles are compared by 64-bit hashes, equal sets by two more.
    """
    return classes(keyed(docs)).select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each class, the one with the smallest id (or place, where ids repeat); all columns kept.

    Texts without words are no copies of each other and stay.
    """
    key = unused(docs, "_near_ref")
    whole = with_key(docs, key)
    rows = whole.select(F.col(key).alias("ref"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gone = materialize(classes(rows).filter(~F.col("stays")).select(F.col("ref").alias(key)))
    return whole.join(gone, key, "left_anti").drop(key)
