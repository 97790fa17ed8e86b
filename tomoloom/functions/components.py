"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoloom.functions.storage import discard, materialize


def _compressed(steps: DataFrame) -> DataFrame:
    """(group, node, root) of (group, node, root) where roots may have roots of their own: each round doubles the steps."""
    while True:
        ahead = steps.select("group", F.col("node").alias("root"), F.col("root").alias("_further"))
        jumped = steps.join(ahead, ["group", "root"], "left")
        longer = materialize(
            jumped.select(
                "group", "node", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")
            )
        )
        discard(steps)
        steps = longer.select("group", "node", "root")
        if longer.filter("_moved").isEmpty():
            return steps


def components(edges: DataFrame) -> DataFrame:
    """(group, node, root): the smallest node of its component for every node that is not itself the smallest.

    `edges` is `(group, a, b)`; nodes of different groups are never joined. In each round every root that has a smaller
    neighbour hooks to the smallest one, chains are compressed and the edges are drawn between roots. At least half of
    the roots that have edges go in each round, so there are logarithmically many; each ends in written tables.
    """

    def between(a: Column, b: Column, of: DataFrame) -> DataFrame:
        pairs = of.select("group", F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        return materialize(pairs.filter("a <> b").distinct())

    left = between(F.col("a"), F.col("b"), edges)
    found = None
    while not left.isEmpty():
        hooks = _compressed(materialize(left.groupBy("group", F.col("a").alias("node")).agg(F.min("b").alias("root"))))
        ends = left
        for end in ("a", "b"):
            roots = hooks.select("group", F.col("node").alias(end), F.col("root").alias(f"_{end}"))
            ends = ends.join(roots, ["group", end], "left")
        contracted = between(F.coalesce("_a", "a"), F.coalesce("_b", "b"), ends)
        discard(left)
        left = contracted
        found = hooks if found is None else _followed(found, hooks)
    return edges.select("group", F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if found is None else found


def _followed(found: DataFrame, hooks: DataFrame) -> DataFrame:
    """Earlier roots that have hooked lead on to their new root; the hooked roots themselves are added."""
    ahead = hooks.select("group", F.col("node").alias("root"), F.col("root").alias("_further"))
    moved = found.join(ahead, ["group", "root"], "left").select("group", "node", F.coalesce("_further", "root").alias("root"))
    out = materialize(moved.unionByName(hooks.select("group", "node", "root")))
    discard(found)
    return out
