"""Shape of voxel sets: connected parts, Euler number, and the graph of a skeleton.

Voxels touch if they share a face, edge or corner. Sets are labelled block by block: a block of `block` voxels a side also
sees the first layer of the blocks behind it, so any two voxels that touch lie together in one block, and the labels that
two blocks give to one voxel belong to one part. Only labels on such seams are united over the whole set.

A voxel's place is one number that grows in scan order, z first; coordinates run from 0 to 2,097,151.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoloom.functions.components import components
from tomoloom.functions.spread import spread_groups
from tomoloom.functions.storage import materialize
from tomoloom.functions.words import WORD, WORD_KEY, to_words
from tomoloom.operators.skeleton import skeleton_degree

AXIS_BITS = 21
_KEY = ("volume_id", "bz", "by", "bx")
_LABELS = "volume_id string, seam boolean, z int, y int, x0 int, x1 int, label bigint"
_PAIRS = "volume_id string, a bigint, b bigint"


def place(z: Column | str = "z", y: Column | str = "y", x: Column | str = "x") -> Column:
    z, y, x = (F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint") for c in (z, y, x))
    return F.shiftleft(z, 2 * AXIS_BITS) + F.shiftleft(y, AXIS_BITS) + x


def _place(z: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (z.astype(np.int64) << 2 * AXIS_BITS) + (y.astype(np.int64) << AXIS_BITS) + x


def at(code: Column | str) -> list[Column]:
    """z, y, x of a place."""
    code, mask = F.col(code) if isinstance(code, str) else code, (1 << AXIS_BITS) - 1
    return [
        F.shiftright(code, 2 * AXIS_BITS).cast("int").alias("z"),
        F.shiftright(code, AXIS_BITS).bitwiseAND(F.lit(mask)).cast("int").alias("y"),
        code.bitwiseAND(F.lit(mask)).cast("int").alias("x"),
    ]


def _by_block(words: DataFrame, block: int, work: Callable, schema: str) -> DataFrame:
    """Apply `work(runs, first, volume)` to the runs of every block and the layer behind it."""
    block_words = block // WORD

    def covering(column: str, size: int) -> Column:
        own = F.floor(F.col(column) / size).cast("int")
        return F.explode(F.when((F.col(column) % size == 0) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own)))

    shared = (
        words.withColumn("bz", covering("z", block)).withColumn("by", covering("y", block)).withColumn("bx", covering("xw", block_words))
    )
    # Of a word behind the block only the first voxel is seen.
    behind = F.col("xw") == (F.col("bx") + 1) * block_words
    shared = shared.withColumn("bits", F.when(behind, F.col("bits").bitwiseAND(F.lit(1))).otherwise(F.col("bits")))

    def run(table: pa.Table) -> pa.Table:
        first = [table.column(c)[0].as_py() * block for c in ("bz", "by", "bx")]
        return work(_runs(table), first, table.column("volume_id")[0].as_py())

    return spread_groups(shared.filter("bits <> 0"), *_KEY).groupBy(*_KEY).applyInArrow(run, schema)


def _runs(table: pa.Table) -> tuple[np.ndarray, ...]:
    """z, y, first and last x of the runs along x, in scan order."""
    z, y, xw = (table.column(c).to_numpy().astype(np.int64) for c in ("z", "y", "xw"))
    order = np.lexsort((xw, y, z))
    z, y, xw = z[order], y[order], xw[order]
    bits = np.ascontiguousarray(table.column("bits").to_numpy()[order])
    row, bit = np.nonzero(np.unpackbits(bits.view(np.uint8), bitorder="little").reshape(-1, WORD))
    z, y, x = z[row], y[row], xw[row] * WORD + bit
    if min(c.min() for c in (z, y, x)) < 0 or max(c.max() for c in (z, y, x)) >> AXIS_BITS:
        raise ValueError(f"coordinates must lie between 0 and {(1 << AXIS_BITS) - 1}")
    new = np.append(True, (np.diff(x) != 1) | (np.diff(y) != 0) | (np.diff(z) != 0))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(x)) - 1
    return z[begin], y[begin], x[begin], x[end]


def _touching_runs(z: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs, the earlier one second, that touch from one line to another."""
    wide = x1.max() + 4
    deep = y.max() + 3
    line = (z - z.min() + 1) * deep + y + 1
    starts, ends = line * wide + x0 + 1, line * wide + x1 + 1
    later, earlier = [], []
    for dz, dy in ((0, -1), (-1, -1), (-1, 0), (-1, 1)):
        other = (line + dz * deep + dy) * wide
        low = np.searchsorted(ends, other + x0)
        high = np.searchsorted(starts, other + x1 + 2, "right")
        count = np.maximum(high - low, 0)
        later.append(np.repeat(np.arange(len(z)), count))
        earlier.append(np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count))
    return np.concatenate(later), np.concatenate(earlier)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each element's component."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further


def _label_block(block: int):
    def work(runs, first, volume) -> pa.Table:
        z, y, x0, x1 = runs
        root = _roots(len(z), *_touching_runs(z, y, x0, x1))
        label = _place(z[root], y[root], x0[root])
        fz, fy, fx = first
        own = (z < fz + block) & (y < fy + block) & (x0 < fx + block)
        # Voxels that another block sees too: in the first layer, or in the layer behind.
        flat = (z == fz) & (z > 0) | (y == fy) & (y > 0) | ~own | (z == fz + block) | (y == fy + block)
        head = ~flat & (x0 == fx) & (fx > 0)
        tail = ~flat & (x1 == fx + block)
        parts = [
            (own, False, x0, np.minimum(x1, fx + block - 1)),
            # A run that lies in a shared layer as a whole is stated by its first voxel there.
            (flat, True, x0, x0),
            (head, True, x0, x0),
            (tail, True, x1, x1),
        ]
        take = np.concatenate([np.flatnonzero(chosen) for chosen, *_ in parts])
        return pa.table(
            {
                "volume_id": pa.array([volume] * len(take), pa.string()),
                "seam": pa.array(np.concatenate([np.full(chosen.sum(), seam) for chosen, seam, *_ in parts])),
                "z": pa.array(z[take].astype(np.int32)),
                "y": pa.array(y[take].astype(np.int32)),
                "x0": pa.array(np.concatenate([low[chosen] for chosen, _, low, _ in parts]).astype(np.int32)),
                "x1": pa.array(np.concatenate([high[chosen] for chosen, _, _, high in parts]).astype(np.int32)),
                "label": pa.array(label[take]),
            }
        )

    return work


def label_runs(voxels: DataFrame, block: int = 128) -> DataFrame:
    """Runs along x with their part: (volume_id, z, y, x0, x1, part), where a part is its first voxel's place.

    Each run ends at a block's border. `voxels` holds (volume_id, z, y, x), repeated rows count once; an empty table has
    no runs.
    """
    if block % WORD:
        raise ValueError("block must be a multiple of 64")
    labelled = materialize(_by_block(to_words(voxels), block, _label_block(block), _LABELS))
    seams = labelled.filter("seam").groupBy("volume_id", "z", "y", "x0").agg(F.collect_set("label").alias("labels"))
    edges = seams.select(
        F.col("volume_id").alias("group"),
        F.explode(F.filter("labels", lambda n: n != F.array_min("labels"))).alias("a"),
        F.array_min("labels").alias("b"),
    )
    roots = components(edges).select(F.col("group").alias("volume_id"), F.col("node").alias("label"), F.col("root"))
    part = F.coalesce("root", "label").alias("part")
    return labelled.filter("not seam").join(roots, ["volume_id", "label"], "left").select("volume_id", "z", "y", "x0", "x1", part)


def label_parts(voxels: DataFrame, block: int = 128) -> DataFrame:
    """Voxels with their part: (volume_id, z, y, x, part)."""
    return label_runs(voxels, block).select("volume_id", "z", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "part")


def part_sizes(voxels: DataFrame, block: int = 128) -> DataFrame:
    """(volume_id, part, z, y, x, voxels): the first voxel of every connected part, and how many it has."""
    sizes = label_runs(voxels, block).groupBy("volume_id", "part").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("voxels"))
    return sizes.select("volume_id", "part", *at("part"), "voxels")


def euler_number(voxels: DataFrame) -> DataFrame:
    """(volume_id, euler_number): parts less tunnels plus cavities of the voxels as closed cubes.

    The corners, edges, faces and cubes of the whole set are counted by bits: a word of 64 voxels is sent to the four
    lines of corners around it, where unions of two or four lines hold the faces and edges that any of them has.
    """
    words = to_words(voxels)
    # The last voxel of a word also has corners in the next word.
    spill = F.when(F.col("bits") < 0, F.struct((F.col("xw") + 1).alias("xw"), F.lit(0).cast("bigint").alias("bits"), F.lit(1).alias("before")))
    own = F.struct(F.col("xw"), F.col("bits"), F.lit(0).alias("before"))
    pieces = F.filter(F.array(own, spill), lambda p: p.isNotNull())
    steps = F.array(*(F.struct(F.lit(z).alias("dz"), F.lit(y).alias("dy")) for z in (0, 1) for y in (0, 1)))
    sent = words.select("volume_id", "z", "y", F.explode(pieces).alias("p"), F.lit(0).alias("_")).select(
        "volume_id", "z", "y", "p", F.explode(steps).alias("s")
    )
    kinds = {
        "cube": (F.col("s.dz") == 0) & (F.col("s.dy") == 0),
        "across_z": F.col("s.dy") == 0,
        "across_y": F.col("s.dz") == 0,
        "corner": F.lit(True),
    }
    lines = sent.groupBy(
        "volume_id", (F.col("z") + F.col("s.dz")).alias("z"), (F.col("y") + F.col("s.dy")).alias("y"), F.col("p.xw").alias("xw")
    ).agg(
        *(F.coalesce(F.bit_or(F.when(held, F.col("p.bits"))), F.lit(0)).alias(kind) for kind, held in kinds.items()),
        *(F.coalesce(F.bit_or(F.when(held, F.col("p.before"))), F.lit(0)).alias(f"{kind}_before") for kind, held in kinds.items()),
    )

    def along(kind: str) -> Column:
        """Cells of one line that have an extent along x."""
        return F.bit_count(kind)

    def between(kind: str) -> Column:
        """Cells at the ends of those: one at each side of a voxel."""
        shifted = F.shiftleft(F.col(kind), 1).bitwiseOR(F.col(f"{kind}_before").cast("bigint"))
        return F.bit_count(F.col(kind).bitwiseOR(shifted))

    corners, edges = between("corner"), along("corner") + between("across_z") + between("across_y")
    faces, cubes = along("across_z") + along("across_y") + between("cube"), along("cube")
    return lines.groupBy("volume_id").agg(F.sum(corners - edges + faces - cubes).cast("bigint").alias("euler_number"))


def topology(voxels: DataFrame, block: int = 128) -> DataFrame:
    """(volume_id, voxels, parts, euler_number) of every volume that has voxels."""
    parts = part_sizes(voxels, block).groupBy("volume_id").agg(F.sum("voxels").alias("voxels"), F.count("part").alias("parts"))
    return parts.join(euler_number(voxels), "volume_id")


def outside(voxels: DataFrame, of: DataFrame) -> DataFrame:
    """(volume_id, outside): voxels that are not in the other set, 0 included; both travel as words."""
    other = to_words(of).select(*WORD_KEY, F.col("bits").alias("_of"))
    beyond = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_of", F.lit(0)))))
    return to_words(voxels).join(other, list(WORD_KEY), "left").groupBy("volume_id").agg(F.sum(beyond).alias("outside"))


def touching_pairs(voxels: DataFrame, block: int = 128) -> DataFrame:
    """(volume_id, a, b): the places of every two voxels that touch, the earlier one first, each pair once."""

    def work(runs, first, volume) -> pa.Table:
        z, y, x0, x1 = runs
        size = x1 - x0 + 1
        later, earlier = _touching_runs(z, y, x0, x1)
        a, b = [], []
        # Along a run, and for each pair of runs all voxels at most one step apart.
        inner = np.repeat(np.arange(len(z)), size - 1)
        x = x0[inner] + np.arange(len(inner)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
        a.append((z[inner], y[inner], x))
        b.append((z[inner], y[inner], x + 1))
        for step in (-1, 0, 1):
            low = np.maximum(x0[later], x0[earlier] - step)
            count = np.maximum(np.minimum(x1[later], x1[earlier] - step) - low + 1, 0)
            pair = np.repeat(np.arange(len(later)), count)
            x = low[pair] + np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            a.append((z[earlier[pair]], y[earlier[pair]], x + step))
            b.append((z[later[pair]], y[later[pair]], x))
        a, b = (np.concatenate([np.stack(part) for part in side], axis=1) for side in (a, b))
        # A pair belongs to the block that holds the smallest coordinate of both on every axis.
        corner = np.minimum(a, b) - np.array(first)[:, None]
        own = ((corner >= 0) & (corner < block)).all(axis=0)
        a, b = a[:, own], b[:, own]
        return pa.table({"volume_id": pa.array([volume] * a.shape[1], pa.string()), "a": _place(*a), "b": _place(*b)})

    return _by_block(to_words(voxels), block, work, _PAIRS)


def skeleton_graph(skeleton: DataFrame, block: int = 128) -> tuple[DataFrame, DataFrame]:
    """Nodes and branches of a skeleton, both written.

    Nodes: (volume_id, node, kind, voxels). A node is an isolated voxel, an end, or junction voxels that touch; its number
    is the place of its first voxel. Branches: (volume_id, branch, start, end, links, steps_1, steps_2, steps_3, length). A
    branch is a chain of links between two nodes, or two nodes that touch of which one is an end; its number is the place
    of its first link or end. A closed chain without a node has no start and end. Steps over a face, an edge or a corner
    of a voxel are counted apart; the length is their sum in voxel sides.
    """
    degrees = materialize(skeleton_degree(skeleton).select("volume_id", "z", "y", "x", "kind"))
    members = [
        label_parts(degrees.filter(F.col("kind") == kind), block).select(
            "volume_id", place().alias("voxel"), F.col("part").alias("item"), F.lit(kind).alias("kind")
        )
        for kind in ("link", "junction")
    ]
    single = degrees.filter("kind in ('end', 'isolated')").select("volume_id", place().alias("voxel"), place().alias("item"), "kind")
    member = materialize(single.unionByName(members[0]).unionByName(members[1]))
    sizes = member.groupBy("volume_id", "item", "kind").agg(F.count(F.lit(1)).alias("voxels"))
    nodes = materialize(sizes.filter("kind <> 'link'").select("volume_id", F.col("item").alias("node"), "kind", "voxels"))

    pairs = touching_pairs(degrees, block)
    for side in ("a", "b"):
        named = member.select("volume_id", F.col("voxel").alias(side), F.col("item").alias(f"{side}_item"), F.col("kind").alias(f"{side}_kind"))
        pairs = pairs.join(named, ["volume_id", side])
    steps = sum((F.abs(p - q) for p, q in zip(at("a"), at("b"))), F.lit(0))
    is_link = {side: F.col(f"{side}_kind") == "link" for side in "ab"}
    # Where a chain meets a node the node is noted; two nodes that touch are a branch of their own.
    branch = F.when(is_link["a"], F.col("a_item")).when(is_link["b"], F.col("b_item")).when(F.col("a_kind") == "end", F.col("a_item")).otherwise(F.col("b_item"))
    met = (
        F.when(is_link["a"] & is_link["b"], F.array().cast("array<bigint>"))
        .when(is_link["a"], F.array("b_item"))
        .when(is_link["b"], F.array("a_item"))
        .otherwise(F.array("a_item", "b_item"))
    )
    kept = pairs.filter("not (a_kind = 'junction' and b_kind = 'junction')")
    drawn = kept.select("volume_id", branch.alias("branch"), met.alias("met"), steps.alias("steps")).groupBy("volume_id", "branch").agg(
        F.array_sort(F.flatten(F.collect_list(F.when(F.size("met") > 0, F.col("met"))))).alias("met"),  # two at most
        *(F.count_if(F.col("steps") == k).alias(f"steps_{k}") for k in (1, 2, 3)),
    )
    links = sizes.filter("kind = 'link'").select("volume_id", F.col("item").alias("branch"), F.col("voxels").alias("links"))
    length = F.col("steps_1") + F.sqrt(F.lit(2.0)) * F.col("steps_2") + F.sqrt(F.lit(3.0)) * F.col("steps_3")
    branches = drawn.join(links, ["volume_id", "branch"], "left").select(
        "volume_id",
        "branch",
        F.get("met", F.lit(0)).alias("start"),
        F.get("met", F.lit(1)).alias("end"),
        F.coalesce("links", F.lit(0)).alias("links"),
        "steps_1",
        "steps_2",
        "steps_3",
        length.alias("length"),
    )
    return nodes, materialize(branches)


def graph_summary(nodes: DataFrame, branches: DataFrame) -> DataFrame:
    """(volume_id, nodes, ends, junctions, isolated, branches, closed, links, node_voxels, parts) of a skeleton's graph.

    `parts` counts the connected parts of the graph itself: nodes joined by branches, and closed chains.
    """
    kinds = nodes.groupBy("volume_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("kind") == "end").alias("ends"),
        F.count_if(F.col("kind") == "junction").alias("junctions"),
        F.count_if(F.col("kind") == "isolated").alias("isolated"),
        F.sum("voxels").alias("node_voxels"),
    )
    drawn = branches.groupBy("volume_id").agg(
        F.count(F.lit(1)).alias("branches"), F.count_if(F.col("start").isNull()).alias("closed"), F.sum("links").alias("links")
    )
    joined = components(branches.filter("start <> end").select(F.col("volume_id").alias("group"), F.col("end").alias("a"), F.col("start").alias("b")))
    hooked = joined.groupBy(F.col("group").alias("volume_id")).agg(F.count(F.lit(1)).alias("_hooked"))
    names = ("nodes", "ends", "junctions", "isolated", "branches", "closed", "links", "node_voxels")
    counted = kinds.join(drawn, "volume_id", "full").join(hooked, "volume_id", "left").fillna(0, [*names, "_hooked"])
    return counted.select("volume_id", *names, (F.col("nodes") - F.col("_hooked") + F.col("closed")).alias("parts"))
