"""Connected components over tables of links, as joins; every round restarts from a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoloom.functions.storage import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node it is linked with over any number of links. links: a, b; nodes are numbers.

    A round takes the smallest label among neighbours, then the label's own label, so long chains need few rounds. Nodes
    without links have no row; an empty table gives none.
    """
    both = materialize(
        links.filter("a <> b").select("a", "b").unionByName(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        lower = labels.join(near, "node", "left").select(
            "node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("label")
        )
        lower = materialize(lower)
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(
            lower.join(jump, "label", "left").select("node", "comp", F.coalesce("next", "label").alias("label"))
        )
        changed = new.filter("label <> comp").limit(1).count()
        discard(lower)
        discard(labels)
        labels = materialize(new.select("node", F.col("label").alias("comp")))
        discard(new)
        if not changed:
            return labels
