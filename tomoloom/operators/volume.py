"""Voxel tables: segmentation, slices, statistics, histogram, Otsu threshold, mask comparison.

A volume is a table `(volume_id, z, y, x, v)`; one table holds any number of volumes. Per-volume numbers are always
partial-aggregated before the shuffle, so one volume may hold most of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoloom.functions.skew import bucketed_totals
from tomoloom.functions.storage import materialize
from tomoloom.functions.words import WORD_KEY, to_words

AXES = ("z", "y", "x")
VOXEL_KEY = ("volume_id", "z", "y", "x")
LEVELS_PER_BUCKET = 65_536


def check_threshold(threshold: float) -> float:
    if not math.isfinite(threshold):
        raise ValueError(f"threshold must be a finite number (got {threshold})")
    return float(threshold)


def check_rank(shape: Sequence[int], what: str = "array") -> None:
    if len(shape) != 3:
        raise ValueError(f"expected a 3D {what}, got shape {tuple(shape)}")


def check_slice(shape: Sequence[int], index: int, axis: int) -> None:
    if axis not in (0, 1, 2):
        raise ValueError(f"axis must be 0, 1, or 2 (got {axis})")
    if not 0 <= index < shape[axis]:
        raise ValueError(f"slice_index {index} out of range for axis {axis} with size {shape[axis]}")


def _as_flag(condition: Column) -> Column:
    return condition.cast("tinyint")


def _above(value: Column, limit: Column | float, inclusive: bool) -> Column:
    # SQL orders NaN above every number; a NaN voxel must stay background.
    passed = value >= limit if inclusive else value > limit
    return passed & ~F.isnan(value.cast("double"))


def stored_limit(threshold: float, dtype: str) -> float:
    """The threshold as a volume of that type compares with it: rounded to the type where it is a shorter real one."""
    limit = check_threshold(threshold)
    return float(np.dtype(dtype).type(limit)) if dtype in ("float16", "float32") else limit


def _limit(voxels: DataFrame, value: str, threshold: float) -> Column:
    kind = voxels.schema[value].dataType.typeName()
    return F.lit(stored_limit(threshold, "float32" if kind == "float" else "float64"))


def segment(voxels: DataFrame, threshold: float, value: str = "v") -> DataFrame:
    """Binary mask `m`: 1 where the value is at or above the threshold, compared in the column's own type."""
    flag = _as_flag(_above(F.col(value), _limit(voxels, value, threshold), inclusive=True))
    return voxels.select(*VOXEL_KEY, flag.alias("m"))


def segment_lines(lines: DataFrame, threshold: float, dtype: str = "float64") -> DataFrame:
    """`segment` for lines of voxels `(volume_id, z, y, run)`, without taking them apart. `dtype` is the stored type."""
    limit = stored_limit(threshold, dtype)
    flags = F.transform("run", lambda v: _as_flag(_above(v, limit, inclusive=True)))
    return lines.select("volume_id", "z", "y", flags.alias("run"))


def binarise(mask: DataFrame, value: str = "m") -> DataFrame:
    """Binary mask of the strictly positive values."""
    return mask.select(*VOXEL_KEY, _as_flag(_above(F.col(value), 0, inclusive=False)).alias("m"))


def has_foreground(mask: DataFrame, value: str = "m") -> DataFrame:
    """Per volume: is any value different from zero (negative values count)?"""
    return mask.groupBy("volume_id").agg(F.bool_or(F.col(value) != 0).alias("has_foreground"))


def require_foreground(mask: DataFrame, value: str = "m") -> None:
    if mask.filter(F.col(value) != 0).isEmpty():
        raise ValueError("input mask has no foreground voxels to skeletonize")


def mask_stats(mask: DataFrame) -> DataFrame:
    """Foreground and background voxels per volume."""
    return mask.groupBy("volume_id").agg(
        F.count_if(F.col("m") != 0).alias("foreground_voxels"),
        F.count_if(F.col("m") == 0).alias("background_voxels"),
    )


def take_slice(
    voxels: DataFrame, index: int, axis: int = 0, value: str = "v", shape: Sequence[int] | None = None
) -> DataFrame:
    """One plane of every volume as `(volume_id, row, col, value)`; the plane filter reaches the scan.

    An index outside the table is rejected; without the volume's `shape` its extent along the axis is looked up.
    """
    if shape is None and axis in (0, 1, 2):
        last = voxels.agg(F.max(AXES[axis])).first()[0]
        shape = [0 if last is None else last + 1] * 3
    check_slice(shape or (0, 0, 0), index, axis)
    row, col = (name for name in AXES if name != AXES[axis])
    return voxels.filter(F.col(AXES[axis]) == index).select(
        "volume_id", F.col(row).alias("row"), F.col(col).alias("col"), F.col(value)
    )


def gray_levels(plane: DataFrame, value: str = "v") -> DataFrame:
    """Slice values scaled to gray 0..255 between the minimum and maximum of each slice; flat slices are 0."""
    limits = materialize(plane.groupBy("volume_id").agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    span = F.col("hi") - F.col("lo")
    gray = F.when(span > 0, F.floor((F.col(value) - F.col("lo")) / span * 255)).otherwise(F.lit(0))
    return plane.join(limits, "volume_id").select("volume_id", "row", "col", gray.cast("int").alias("gray"))


def slice_range(plane: DataFrame, value: str = "v") -> DataFrame:
    """Shape and value range of each slice."""
    return plane.groupBy("volume_id").agg(
        (F.max("row") + 1).alias("n_rows"),
        (F.max("col") + 1).alias("n_cols"),
        F.min(value).alias("min_v"),
        F.max(value).alias("max_v"),
    )


def profile(voxels: DataFrame, value: str = "v") -> DataFrame:
    """Shape, voxel count, minimum, maximum and mean per volume; any NaN makes all three statistics NaN."""
    v = F.col(value).cast("double")
    spoiled = F.max(F.isnan(v))

    def unless_spoiled(stat: Column) -> Column:
        return F.when(spoiled, F.lit(float("nan"))).otherwise(stat)

    return voxels.groupBy("volume_id").agg(
        (F.max("z") + 1).alias("nz"),
        (F.max("y") + 1).alias("ny"),
        (F.max("x") + 1).alias("nx"),
        F.count(F.lit(1)).alias("n_voxels"),
        unless_spoiled(F.min(v)).alias("min_v"),
        unless_spoiled(F.max(v)).alias("max_v"),
        unless_spoiled(F.avg(v)).alias("mean_v"),
    )


def _value_limits(voxels: DataFrame, value: str) -> DataFrame:
    """Range of each volume, widened by half a unit on both sides where it is a single value."""
    v = F.col(value).cast("double")
    limits = voxels.groupBy("volume_id").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    # Not-a-number is the largest value here; like an infinite end it leaves no range to divide.
    endless = F.isnan("hi") | (F.col("hi") == float("inf")) | (F.col("lo") == float("-inf"))
    refused = F.raise_error(F.concat(F.lit("autodetected range is not finite in volume "), F.col("volume_id").cast("string")))
    limits = limits.withColumn("hi", F.when(endless, refused.cast("double")).otherwise(F.col("hi")))
    flat = F.col("lo") == F.col("hi")
    return limits.select(
        "volume_id",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        flat.alias("is_flat"),
    )


def _with_bin(voxels: DataFrame, limits: DataFrame, bins: int, value: str) -> DataFrame:
    """Add `lo`, `hi` and the equal-width `bin`; bins are closed on the left, the last one on both sides."""
    v, lo, hi = F.col(value).cast("double"), F.col("lo"), F.col("hi")
    step = (hi - lo) / bins
    guess = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))
    # The guess can be one off next to an edge; the edges decide.
    settled = (
        F.when(v < lo + F.col("_guess") * step, F.col("_guess") - 1)
        .when(
            (F.col("_guess") < bins - 1) & (v >= lo + (F.col("_guess") + 1) * step), F.col("_guess") + 1
        )
        .otherwise(F.col("_guess"))
    )
    return (
        voxels.join(limits, "volume_id")
        .withColumn("_guess", guess)
        .withColumn("bin", settled.cast("int"))
        .drop("_guess")
    )


def histogram(voxels: DataFrame, bins: int = 200, value: str = "v") -> DataFrame:
    """Equal-width histogram per volume with empty bins included: `(volume_id, bin, lower, upper, voxels)`."""
    limits = materialize(_value_limits(voxels, value))
    counts = _with_bin(voxels, limits, bins, value).groupBy("volume_id", "bin").agg(
        F.count(F.lit(1)).alias("voxels")
    )
    step = (F.col("hi") - F.col("lo")) / bins
    frame = limits.select(
        "volume_id", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    ).select(
        "volume_id",
        "bin",
        (F.col("lo") + F.col("bin") * step).alias("lower"),
        F.when(F.col("bin") == bins - 1, F.col("hi"))
        .otherwise(F.col("lo") + (F.col("bin") + 1) * step)
        .alias("upper"),
    )
    return frame.join(counts, ["volume_id", "bin"], "left").select(
        "volume_id", "bin", "lower", "upper", F.coalesce("voxels", F.lit(0)).alias("voxels")
    )


def _best_split(levels: DataFrame) -> DataFrame:
    """Per volume the level after which splitting `(volume_id, level, n)` separates the two classes most."""
    levels = materialize(levels).withColumn("_bucket", F.floor(F.col("level") / LEVELS_PER_BUCKET))
    run = bucketed_totals(
        levels,
        ["volume_id"],
        [("_bucket", False)],
        [F.asc("level")],
        {"w1": F.col("n"), "s1": F.col("level") * F.col("n")},
    )
    w1, s1 = F.col("w1").cast("double"), F.col("s1").cast("double")
    w2 = (F.col("w1_all") - F.col("w1")).cast("double")
    s2 = (F.col("s1_all") - F.col("s1")).cast("double")
    gap = s1 / w1 - s2 / w2
    between = F.when(F.col("w1") < F.col("w1_all"), w1 * w2 * (gap * gap))
    best = F.max(F.when(between.isNotNull(), F.struct(between.alias("b"), (-F.col("level")).alias("l"))))
    return run.groupBy("volume_id").agg(F.coalesce(-best["l"], F.min("level")).alias("level"))


def otsu_threshold(voxels: DataFrame, value: str = "v") -> DataFrame:
    """Otsu's threshold per volume of an integer-valued column; every grey level is its own bin.

    A value that is no whole number is an error: `otsu_threshold_binned` is for those.
    """
    v = F.col(value)
    level = v.cast("bigint")
    if voxels.schema[value].dataType.typeName() in ("float", "double"):
        level = F.when(v == F.floor(v), level).otherwise(F.raise_error(F.lit("values are not whole numbers")).cast("bigint"))
    levels = voxels.groupBy("volume_id", level.alias("level")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return _best_split(levels).select("volume_id", F.col("level").alias("threshold"))


def otsu_threshold_binned(voxels: DataFrame, bins: int = 256, value: str = "v") -> DataFrame:
    """Otsu's threshold per volume of a real-valued column: the centre of the best of `bins` equal bins."""
    limits = materialize(_value_limits(voxels, value))
    levels = _with_bin(voxels, limits, bins, value).groupBy(
        "volume_id", F.col("bin").cast("bigint").alias("level")
    ).agg(F.count(F.lit(1)).alias("n"))
    step = (F.col("hi") - F.col("lo")) / bins
    centre = (F.col("lo") + F.col("level") * step + F.col("lo") + (F.col("level") + 1) * step) / 2
    # A single-valued volume has no split; its own value is the threshold.
    threshold = F.when(F.col("is_flat"), (F.col("lo") + F.col("hi")) / 2).otherwise(centre)
    return _best_split(levels).join(limits, "volume_id").select("volume_id", threshold.alias("threshold"))


def segment_above(voxels: DataFrame, thresholds: DataFrame, value: str = "v") -> DataFrame:
    """Mask of values strictly above each volume's own `threshold`."""
    joined = voxels.join(materialize(thresholds), "volume_id")
    flag = _as_flag(_above(F.col(value), F.col("threshold"), inclusive=False))
    return joined.select(*VOXEL_KEY, flag.alias("m"))


def threshold_sweep(voxels: DataFrame, thresholds: Sequence[float], value: str = "v") -> DataFrame:
    """Foreground count for each of a list of thresholds, in one pass over the voxels."""
    counts = [
        F.struct(
            F.lit(check_threshold(t)).alias("threshold"),
            F.count_if(_above(F.col(value), _limit(voxels, value, t), inclusive=True)).alias("foreground_voxels"),
        )
        for t in thresholds
    ]
    swept = voxels.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n_voxels"), F.array(*counts).alias("c"))
    return swept.select("volume_id", "n_voxels", F.inline("c"))


def compare_masks(result: DataFrame, truth: DataFrame) -> DataFrame:
    """Voxel agreement of two masks per volume; a voxel missing from one side is background there.

    Masks are compared as words of 64 voxels.
    """
    words = to_words(result.filter(F.col("m") != 0)).withColumnRenamed("bits", "r")
    truths = to_words(truth.filter(F.col("m") != 0)).withColumnRenamed("bits", "t")
    pairs = words.join(truths, list(WORD_KEY), "full")
    none = F.lit(0).cast("bigint")
    r, t = F.coalesce("r", none), F.coalesce("t", none)

    def voxels(bits: Column) -> Column:
        return F.coalesce(F.sum(F.bit_count(bits)), F.lit(0))

    counts = pairs.groupBy("volume_id").agg(
        voxels(r.bitwiseAND(t)).alias("true_positives"),
        voxels(r.bitwiseAND(F.bitwise_not(t))).alias("false_positives"),
        voxels(t.bitwiseAND(F.bitwise_not(r))).alias("false_negatives"),
    )
    # Volumes without any material have no word.
    every = result.select("volume_id").unionByName(truth.select("volume_id")).distinct()
    filled = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("true_positives", "false_positives", "false_negatives")}
    counts = every.join(counts, "volume_id", "left").select("volume_id", *filled.values())
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    return counts.withColumns(
        {"iou": F.try_divide(tp, tp + fp + fn), "dice": F.try_divide(2 * tp, 2 * tp + fp + fn)}
    )
