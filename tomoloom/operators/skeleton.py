"""3D curve skeletons by topology-preserving thinning, block by block.

Border voxels are removed one face direction after the other, in eight parity classes, as long as their removal keeps
the number of parts, loops and cavities (simple points after Bertrand and Malandain; direction sub-iterations after
Lee, Kashyap and Chu, 1994). A voxel's fate under one direction depends on voxels at most nine steps away: one for the
border layer, eight for the parity classes. A block with a margin of nine per direction therefore gives the same
result as the whole volume, whatever the block size.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoloom.functions.spread import spread_groups
from tomoloom.functions.storage import discard, materialize
from tomoloom.functions.words import WORD, WORD_KEY, to_voxels, to_words

REACH = 9
DIRECTIONS = tuple((axis, step) for axis in range(3) for step in (-1, 1))

_STEPS = [s for s in itertools.product((-1, 0, 1), repeat=3) if any(s)]
_WORDS = "volume_id string, z int, y int, xw int, bits bigint"


def _touching(steps: int, allowed: list[bool]) -> np.ndarray:
    """For each of the 26 positions, the set of allowed positions next to it; `steps` is the L1 distance permitted."""
    masks = np.zeros(26, np.int64)
    for i, a in enumerate(_STEPS):
        for j, b in enumerate(_STEPS):
            gap = [abs(p - q) for p, q in zip(a, b, strict=True)]
            if i != j and allowed[j] and max(gap) == 1 and sum(gap) <= steps:
                masks[i] |= 1 << j
    return masks


def _positions(most: int) -> int:
    return sum(1 << i for i, s in enumerate(_STEPS) if sum(map(abs, s)) <= most)


_ALL, _NEAR, _FACES = _positions(3), _positions(2), _positions(1)
_NEXT_26 = _touching(3, [True] * 26)
_NEXT_6 = _touching(1, [bool(_NEAR >> i & 1) for i in range(26)])


def _flood(start: np.ndarray, allowed: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """Grow each start set inside its allowed set until it stops changing."""
    reached = start
    while True:
        grown = reached
        for i in range(26):
            grown = grown | np.where(reached >> i & 1, neighbours[i], 0)
        grown = grown & allowed
        if np.array_equal(grown, reached):
            return reached
        reached = grown


def removable(codes: np.ndarray) -> np.ndarray:
    """Which 26-neighbourhoods (one bit per neighbour) allow removing the centre: simple and not a line end."""
    solid = codes & _ALL
    one_part = _flood(solid & -solid, solid, _NEXT_26) == solid
    empty = ~codes & _NEAR
    open_faces = empty & _FACES
    one_outside = (_flood(open_faces & -open_faces, empty, _NEXT_6) & open_faces) == open_faces
    return one_part & one_outside & (open_faces != 0) & (np.bitwise_count(solid) > 1)


def thin_array(grid: np.ndarray, origin: tuple[int, int, int], directions) -> np.ndarray:
    """Apply direction sub-iterations to a padded 0/1 array in place; the outermost layer must be 0."""
    flat = grid.reshape(-1)
    strides = (grid.shape[1] * grid.shape[2], grid.shape[2], 1)
    offsets = np.array([sum(d * s for d, s in zip(step, strides, strict=True)) for step in _STEPS])
    weights = np.int64(1) << np.arange(26, dtype=np.int64)
    for axis, step in directions:
        solid = np.flatnonzero(flat)
        layer = solid[flat[solid + step * strides[axis]] == 0]
        place = np.unravel_index(layer, grid.shape)
        parity = sum(((p + o) & 1) << i for i, (p, o) in enumerate(zip(place, origin, strict=True)))
        for phase in range(8):
            points = layer[parity == phase]
            if points.size:
                codes = flat[points[:, None] + offsets].astype(np.int64) @ weights
                kinds, which = np.unique(codes, return_inverse=True)
                flat[points[removable(kinds)[which]]] = 0
    return grid


def _thin_blocks(words: DataFrame, directions, block: int) -> DataFrame:
    margin = REACH * len(directions)
    word_margin = -(-margin // WORD)
    block_words = block // WORD

    def covering(column: str, size: int, reach: int):
        first = F.floor((F.col(column) - reach) / size)
        return F.explode(F.sequence(first, F.floor((F.col(column) + reach) / size)))

    def thin(table: pa.Table) -> pa.Table:
        bz, by, bx = (table.column(c)[0].as_py() for c in ("bz", "by", "bx"))
        z, y, xw = (table.column(c).to_numpy().astype(np.int64) for c in ("z", "y", "xw"))
        own = (z // block == bz) & (y // block == by) & (xw // block_words == bx)
        kept = np.zeros(own.sum(), np.int64)
        if own.any():
            first = [c.min() for c in (z, y, xw)]
            extent = [c.max() - c.min() + 1 for c in (z, y, xw)]
            lanes = np.zeros((*extent, WORD), np.uint8)
            place = tuple(c - f for c, f in zip((z, y, xw), first, strict=True))
            bits = np.ascontiguousarray(table.column("bits").to_numpy())
            lanes[place] = np.unpackbits(bits.view(np.uint8), bitorder="little").reshape(-1, WORD)
            grid = np.pad(lanes.reshape(extent[0], extent[1], extent[2] * WORD), 1)
            thin_array(grid, (first[0] - 1, first[1] - 1, first[2] * WORD - 1), directions)
            lanes = np.ascontiguousarray(grid[1:-1, 1:-1, 1:-1]).reshape(*extent, WORD)
            mine = lanes[tuple(c[own] for c in place)]
            kept = np.packbits(mine, axis=-1, bitorder="little").reshape(-1).view(np.int64)
        columns = ("volume_id", "z", "y", "xw")
        out = table.select(columns).filter(pa.array(own)).append_column("bits", pa.array(kept))
        return out.filter(pa.array(kept != 0))

    shared = (
        words.withColumn("bz", covering("z", block, margin))
        .withColumn("by", covering("y", block, margin))
        .withColumn("bx", covering("xw", block_words, word_margin))
    )
    key = ("volume_id", "bz", "by", "bx")
    return spread_groups(shared, *key).groupBy(*key).applyInArrow(thin, _WORDS)


def _sizes(words: DataFrame) -> DataFrame:
    """Voxels per volume, written once."""
    return materialize(words.groupBy("volume_id").agg(F.sum(F.bit_count("bits")).alias("n")))


def skeletonise(mask: DataFrame, block: int = 128, directions_per_exchange: int = 3, value: str = "m") -> DataFrame:
    """Skeleton voxels `(volume_id, z, y, x)` of a mask table; values above 0 are material.

    Each exchange is one shuffle of 64-voxel words to blocks with margins, followed by a written table, so a lost
    executor costs one exchange. `directions_per_exchange` (1, 2, 3 or 6) trades wider margins for fewer exchanges.
    Passes repeat until one removes nothing; about one pass per voxel of the thickest part's radius. Once half of the
    voxels belong to volumes that no longer change, those volumes are set aside.
    """
    if block % WORD or 6 % directions_per_exchange:
        raise ValueError("block must be a multiple of 64 and directions_per_exchange must divide 6")
    solid = mask.filter((F.col(value) > 0) & ~F.isnan(F.col(value).cast("double")))
    words = materialize(to_words(solid))
    before = _sizes(words)
    finished = []
    while True:
        for start in range(0, len(DIRECTIONS), directions_per_exchange):
            chosen = DIRECTIONS[start : start + directions_per_exchange]
            thinner = materialize(_thin_blocks(words, chosen, block))
            discard(words)
            words = thinner
        after = _sizes(words)
        changed = after.join(before.withColumnRenamed("n", "n_before"), "volume_id").filter("n < n_before")
        moving = changed.agg(F.sum("n").alias("n")).first()["n"]
        if moving is None:
            return to_voxels(reduce(DataFrame.unionByName, [*finished, words]))
        if 2 * moving <= after.agg(F.sum("n").alias("n")).first()["n"]:
            active = materialize(changed.select("volume_id"))
            finished.append(materialize(words.join(active, "volume_id", "left_anti").select(*words.columns)))
            remaining = materialize(words.join(active, "volume_id", "left_semi").select(*words.columns))
            discard(words)
            words = remaining
        before = after


def skeleton_degree(skeleton: DataFrame) -> DataFrame:
    """Number of skeleton voxels among the 26 neighbours of each, and what it makes the voxel.

    0 is isolated, 1 an end, 2 a link, 3 or more a junction. Voxels travel as words of 64: a word is sent to the nine
    lines around it and, where its outermost voxels are set, to the words beside it there. Only the voxels of the
    result are taken apart.
    """
    words = to_words(skeleton).select(*WORD_KEY, "bits")
    lines = F.array(*(F.struct(F.lit(z).alias("dz"), F.lit(y).alias("dy")) for z in (-1, 0, 1) for y in (-1, 0, 1)))
    bits = F.col("bits")
    left = F.when(bits < 0, F.lit(1).cast("bigint"))  # the last voxel, first neighbour of the next word
    right = F.when(bits.bitwiseAND(F.lit(1)) != 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(63)))
    places = F.filter(
        F.array(
            F.struct(F.lit(0).alias("dx"), bits.alias("part")),
            F.struct(F.lit(1).alias("dx"), left.alias("part")),
            F.struct(F.lit(-1).alias("dx"), right.alias("part")),
        ),
        lambda p: p["part"].isNotNull(),
    )
    sent = words.select("*", F.explode(lines).alias("s")).select("*", F.explode(places).alias("p"))
    # A word's own line adds its voxels' neighbours along x, the others theirs and those straight across.
    around = sent.select(
        "volume_id",
        (F.col("z") + F.col("s.dz")).alias("z"),
        (F.col("y") + F.col("s.dy")).alias("y"),
        (F.col("xw") + F.col("p.dx")).alias("xw"),
        F.struct(F.col("p.dx").alias("dx"), ((F.col("s.dz") == 0) & (F.col("s.dy") == 0)).alias("own"), F.col("p.part").alias("part")).alias("n"),
    )
    met = (
        around.groupBy(*WORD_KEY)
        .agg(F.collect_list("n").alias("near"))
        .withColumn("bits", F.get(F.filter("near", lambda n: n["own"] & (n["dx"] == 0)), F.lit(0))["part"])
        .filter("bits is not null")
    )  # at most 27 parts per word

    def has(part: Column, x: Column) -> Column:
        return F.when(x.between(0, WORD - 1), F.call_function("getbit", part, F.pmod(x, F.lit(WORD))).cast("int")).otherwise(0)

    def count(near: Column, x: Column) -> Column:
        def one(n: Column) -> Column:
            beside = has(n["part"], x - 1) + has(n["part"], x + 1)
            across = F.when(n["own"], 0).otherwise(has(n["part"], x))
            return F.when(n["dx"] == 0, beside + across).when(n["dx"] == 1, F.when(x == 0, 1).otherwise(0)).otherwise(
                F.when(x == WORD - 1, 1).otherwise(0)
            )

        return F.aggregate(near, F.lit(0), lambda total, n: total + one(n))

    set_bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    voxels = met.select(*WORD_KEY, "near", F.explode(set_bits).alias("_x"))
    counted = voxels.select(
        "volume_id", "z", "y", (F.col("xw") * WORD + F.col("_x")).alias("x"), count(F.col("near"), F.col("_x")).alias("degree")
    )
    kind = (
        F.when(F.col("degree") == 0, "isolated")
        .when(F.col("degree") == 1, "end")
        .when(F.col("degree") == 2, "link")
        .otherwise("junction")
    )
    return counted.select("volume_id", "z", "y", "x", "degree", kind.alias("kind"))


def degree_counts(degrees: DataFrame) -> DataFrame:
    return degrees.groupBy("volume_id", "kind").agg(F.count(F.lit(1)).alias("voxels"))
