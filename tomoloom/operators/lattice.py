"""Lattice graphs: element counts, junction extent, and strut presence in a segmented volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoloom.functions.words import WORD, to_words, word_bit
from tomoloom.schemas import LATTICE_JSON

VOXEL_AXES = ("z", "y", "x")
ENDS = ("x0", "y0", "z0", "x1", "y1", "z1")


def graph_profile(junctions: DataFrame, struts: DataFrame, unit_cells: DataFrame) -> DataFrame:
    """Junction, strut and cell counts with the junctions' bounding box, in one aggregation.

    Inputs need `graph_id`; junctions also `x, y, z`. Box limits stay unrounded and are null without junctions.
    """
    box = ("x", "y", "z")
    parts = junctions.select("graph_id", F.lit("j").alias("kind"), *box)
    for frame, kind in ((struts, "s"), (unit_cells, "c")):
        blank = [F.lit(None).cast("double").alias(d) for d in box]
        parts = parts.unionByName(frame.select("graph_id", F.lit(kind).alias("kind"), *blank))
    return parts.groupBy("graph_id").agg(
        F.count_if(F.col("kind") == "j").alias("junctions"),
        F.count_if(F.col("kind") == "s").alias("struts"),
        F.count_if(F.col("kind") == "c").alias("unit_cells"),
        *(F.min(d).alias(f"min_{d}") for d in box),
        *(F.max(d).alias(f"max_{d}") for d in box),
    )


def parse_graphs(documents: DataFrame, text: str = "text") -> DataFrame:
    """Parse lattice JSON held in a text column; an absent list becomes null."""
    return documents.withColumn("graph", F.from_json(text, LATTICE_JSON)).select(
        *(c for c in documents.columns if c != text), "graph.*"
    )


def json_profile(graphs: DataFrame) -> DataFrame:
    """Counts and bounding box of parsed lattice documents, row by row; missing lists count 0."""

    def size(column: str):
        return F.coalesce(F.array_size(column), F.lit(0)).cast("bigint")

    def extent(pick, axis: int):
        return pick(F.transform("junctions", lambda j: j["position"][axis]))

    box = [
        extent(pick, axis).alias(f"{name}_{d}")
        for name, pick in (("min", F.array_min), ("max", F.array_max))
        for axis, d in enumerate("xyz")
    ]
    kept = [c for c in graphs.columns if c not in ("junctions", "struts", "unit_cells")]
    return graphs.select(
        *kept,
        size("junctions").alias("junctions"),
        size("struts").alias("struts"),
        size("unit_cells").alias("unit_cells"),
        *box,
    )


def strut_coverage(struts: DataFrame, mask: DataFrame, broken_below: float = 0.9) -> DataFrame:
    """Share of each strut's voxels that the mask fills, with `missing` and `broken` flags.

    A strut `(graph_id, strut_id, x0..z1)` in voxel units is sampled once per voxel of its longest extent, both ends
    included, so no voxel along it is passed over. `graph_id` names the volume. The mask is joined as words of 64
    voxels along x. A strut with no filled voxel is missing; one filled below `broken_below` is broken.
    """
    extent = F.greatest(*(F.abs(F.col(f"{d}1") - F.col(f"{d}0")) for d in VOXEL_AXES))
    last = F.ceil(extent).cast("int")

    def voxel(d: str, step: Column) -> Column:
        along = F.col(f"{d}0") + F.when(F.col("_last") > 0, step / F.col("_last") * (F.col(f"{d}1") - F.col(f"{d}0"))).otherwise(0.0)
        return F.floor(along + 0.5).cast("int")

    # Each coordinate only ever moves one way along a strut, so repeats of a voxel are consecutive samples.
    step = F.col("_i")
    moved = [voxel(d, step) != voxel(d, step - 1) for d in VOXEL_AXES]
    visited = (
        struts.select("graph_id", "strut_id", *ENDS, last.alias("_last"))
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_last"))))
        .filter((step == 0) | moved[0] | moved[1] | moved[2])
        .select("graph_id", "strut_id", *(voxel(d, step).alias(d) for d in VOXEL_AXES))
        .withColumn("xw", F.floor(F.col("x") / WORD).cast("int"))
    )
    # Voxels of a strut in one word meet it together.
    asked = visited.groupBy("graph_id", "strut_id", "z", "y", "xw").agg(
        F.bit_or(word_bit("x")).alias("asked"), F.count(F.lit(1)).alias("voxels")
    )
    solid = to_words(mask.filter(F.col("m") != 0)).withColumnRenamed("volume_id", "graph_id")
    per_strut = (
        asked.join(solid, ["graph_id", "z", "y", "xw"], "left")
        .groupBy("graph_id", "strut_id")
        .agg(
            F.sum("voxels").alias("voxels"),
            F.sum(F.coalesce(F.bit_count(F.col("asked").bitwiseAND(F.col("bits"))), F.lit(0))).alias("filled"),
        )
    )
    return per_strut.select(
        "graph_id",
        "strut_id",
        "voxels",
        "filled",
        (F.col("filled") == 0).alias("missing"),
        ((F.col("filled") > 0) & (F.col("filled") < broken_below * F.col("voxels"))).alias("broken"),
    )


def strut_defects(coverage: DataFrame) -> DataFrame:
    """Missing and broken struts per graph, and the percentage missing."""
    counts = coverage.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("struts"),
        F.count_if("missing").alias("missing"),
        F.count_if("broken").alias("broken"),
    )
    return counts.withColumn("missing_percent", F.col("missing") * 100.0 / F.col("struts"))


def node_degree(struts: DataFrame) -> DataFrame:
    """Number of strut ends that meet at each point of a graph."""
    first = struts.select("graph_id", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("z0").alias("z"))
    second = struts.select("graph_id", F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("z1").alias("z"))
    return first.unionAll(second).groupBy("graph_id", "x", "y", "z").agg(F.count(F.lit(1)).alias("degree"))
