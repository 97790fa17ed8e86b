"""Triangle meshes: extent and plane cross-section, as column expressions without a shuffle of the triangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoloom.functions.storage import materialize


def z_range(triangles: DataFrame) -> DataFrame:
    """Triangle count, vertical extent and mid-height of each mesh."""
    extent = triangles.groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("n_triangles"),
        F.min(F.least("az", "bz", "cz")).alias("z_min"),
        F.max(F.greatest("az", "bz", "cz")).alias("z_max"),
    )
    return extent.withColumn("z_mid", (F.col("z_min") + F.col("z_max")) / 2)


def _cut(a: str, b: str, plane: Column) -> Column:
    """Point where the edge from vertex `a` to vertex `b` meets the plane."""
    t = (plane - F.col(f"{a}z")) / (F.col(f"{b}z") - F.col(f"{a}z"))
    return F.struct(
        *(
            (F.col(f"{a}{d}") + t * (F.col(f"{b}{d}") - F.col(f"{a}{d}"))).alias(d)
            for d in ("x", "y")
        )
    )


def cross_section(triangles: DataFrame, plane: Column | float) -> DataFrame:
    """One segment per triangle that has vertices both above the plane and at or below it.

    Exactly two of a crossing triangle's edges change sides; the endpoints follow the edge order ab, bc, ca.
    """
    plane = plane if isinstance(plane, Column) else F.lit(float(plane))
    above = {v: F.col(f"{v}z") > plane for v in "abc"}
    n_above = sum((above[v].cast("int") for v in "abc"), F.lit(0))
    start = F.when(above["a"] != above["b"], _cut("a", "b", plane)).otherwise(_cut("b", "c", plane))
    end = F.when(above["c"] != above["a"], _cut("c", "a", plane)).otherwise(_cut("b", "c", plane))
    return (
        triangles.filter(n_above.between(1, 2))
        .select("mesh_id", "tri_id", start.alias("p"), end.alias("q"))
        .select(
            "mesh_id",
            "tri_id",
            F.col("p.x").alias("x0"),
            F.col("p.y").alias("y0"),
            F.col("q.x").alias("x1"),
            F.col("q.y").alias("y1"),
        )
    )


def mid_section(triangles: DataFrame) -> DataFrame:
    """Cross-section of each mesh at the middle of its own vertical extent."""
    middle = materialize(z_range(triangles).select("mesh_id", "z_mid"))
    return cross_section(triangles.join(middle, "mesh_id"), F.col("z_mid"))
