import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrays import mask_rows, voxel_rows
from tomoloom.operators import volume

GOLDEN = np.array([[[0.1, 0.5], [0.6, 0.4]], [[0.8, 0.2], [0.5, 0.0]]], dtype=np.float32)
GOLDEN_MASK = np.array([[[0, 1], [1, 0]], [[1, 0], [1, 0]]], dtype=np.uint8)


def dense(rows, shape, name):
    out = np.zeros(shape, dtype=object)
    for r in rows.collect():
        out[r.z, r.y, r.x] = r[name]
    return out


def random_volume(seed=0, shape=(5, 6, 7)):
    return np.random.default_rng(seed).normal(size=shape)


def test_threshold_is_inclusive(spark):
    mask = volume.segment(voxel_rows(spark, GOLDEN), 0.5)
    assert dict(mask.dtypes)["m"] == "tinyint"
    assert np.array_equal(dense(mask, GOLDEN.shape, "m").astype("u1"), GOLDEN_MASK)
    assert volume.mask_stats(mask).first()["foreground_voxels"] == 4


def test_lines_and_voxels_are_segmented_alike(spark):
    array = random_volume(11)
    array[0, 0, 0] = math.nan
    lines = spark.createDataFrame(
        [("v", z, y, [float(v) for v in array[z, y]]) for z, y in np.ndindex(array.shape[:2])],
        "volume_id string, z int, y int, run array<double>",
    )
    for r in volume.segment_lines(lines, 0.25).collect():
        assert r.run == (array[r.z, r.y] >= 0.25).astype(int).tolist()


def test_nan_is_background_for_every_comparison(spark):
    rows = voxel_rows(spark, np.array([[[math.nan, 1.0]]]))
    assert [r.m for r in volume.segment(rows, 0.5).orderBy("x").collect()] == [0, 1]
    assert [r.m for r in volume.binarise(rows, "v").orderBy("x").collect()] == [0, 1]
    limits = rows.select("volume_id").distinct().withColumn("threshold", F.lit(0.5))
    assert [r.m for r in volume.segment_above(rows, limits).orderBy("x").collect()] == [0, 1]


@pytest.mark.parametrize("threshold", [math.nan, math.inf, -math.inf])
def test_threshold_must_be_finite(spark, threshold):
    with pytest.raises(ValueError, match="threshold must be a finite number"):
        volume.segment(voxel_rows(spark, GOLDEN), threshold)


def test_positive_and_nonzero_differ_on_negative_values(spark):
    rows = mask_rows(spark, np.array([[[-1, 0]]]), dense=True)
    assert volume.has_foreground(rows).first()["has_foreground"]
    assert volume.mask_stats(volume.binarise(rows)).first()["foreground_voxels"] == 0


@pytest.mark.parametrize("axis", [0, 1, 2])
def test_slice_matches_take(spark, axis):
    array = random_volume()
    plane = volume.take_slice(voxel_rows(spark, array), 3, axis, shape=array.shape)
    expected = np.take(array, 3, axis=axis)
    found = np.zeros(expected.shape)
    for r in plane.collect():
        found[r["row"], r["col"]] = r["v"]
    assert np.array_equal(found, expected)


@pytest.mark.parametrize(
    ("index", "axis", "message"),
    [
        (0, 3, r"axis must be 0, 1, or 2 \(got 3\)"),
        (5, 0, "slice_index 5 out of range for axis 0 with size 5"),
        (-1, 1, "slice_index -1 out of range for axis 1 with size 6"),
    ],
)
def test_bad_slices_are_refused(spark, index, axis, message):
    array = random_volume()
    with pytest.raises(ValueError, match=message):
        volume.take_slice(voxel_rows(spark, array), index, axis, shape=array.shape)


def test_rank_is_checked():
    with pytest.raises(ValueError, match=r"expected a 3D array, got shape \(2, 2\)"):
        volume.check_rank((2, 2))


def test_gray_levels_span_the_slice(spark):
    array = random_volume(3)
    gray = volume.gray_levels(volume.take_slice(voxel_rows(spark, array), 2))
    plane = array[2]
    expected = np.floor((plane - plane.min()) / (plane.max() - plane.min()) * 255)
    for r in gray.collect():
        assert r.gray == expected[r["row"], r["col"]]
    flat = volume.gray_levels(volume.take_slice(voxel_rows(spark, np.full((1, 2, 2), 7.0)), 0))
    assert {r.gray for r in flat.collect()} == {0}


def test_profile_per_volume(spark):
    a, b = random_volume(1), random_volume(2, (2, 3, 4))
    b[1, 1, 1] = np.nan
    rows = voxel_rows(spark, a, "a").unionAll(voxel_rows(spark, b, "b"))
    found = {r.volume_id: r for r in volume.profile(rows).collect()}
    assert (found["a"].nz, found["a"].ny, found["a"].nx) == a.shape
    assert found["a"].min_v == a.min() and found["a"].max_v == a.max()
    assert found["a"].mean_v == pytest.approx(a.mean())
    assert all(math.isnan(found["b"][c]) for c in ("min_v", "max_v", "mean_v"))


@pytest.mark.parametrize(
    "values",
    [
        np.random.default_rng(0).normal(size=4000),
        np.random.default_rng(1).integers(0, 201, 4000) / 200.0,
        np.random.default_rng(2).integers(0, 7, 500) * 0.1,
        np.full(50, 3.25),
    ],
    ids=["normal", "on_edges", "few_levels", "constant"],
)
def test_histogram_matches_numpy(spark, values):
    array = values.reshape(-1, 5, 10)
    counts, edges = np.histogram(values, bins=200)
    found = volume.histogram(voxel_rows(spark, array)).orderBy("bin").collect()
    assert [r.voxels for r in found] == counts.tolist()
    assert [r.lower for r in found] == edges[:-1].tolist()
    assert found[-1].upper == edges[-1]


def otsu_by_hand(values, levels):
    best, chosen = -1.0, levels[0]
    for level in levels[:-1]:
        low, high = values[values <= level], values[values > level]
        if low.size and high.size:
            between = low.size * high.size * (low.mean() - high.mean()) ** 2
            if between > best * (1 + 1e-12):
                best, chosen = between, level
    return chosen


def test_otsu_on_integers_over_several_volumes(spark):
    rng = np.random.default_rng(4)
    arrays = {
        "two_peaks": np.concatenate([rng.normal(400, 60, 600), rng.normal(60_000, 900, 200)]).astype(int),
        "wide": rng.integers(-200_000, 200_000, 800),
        "constant": np.full(800, 7),
        "pair": np.array([3, 9] * 400),
    }
    rows = None
    for name, values in arrays.items():
        one = voxel_rows(spark, values.reshape(8, 10, 10), name, "g", "int")
        rows = one if rows is None else rows.unionAll(one)
    found = {r.volume_id: r.threshold for r in volume.otsu_threshold(rows, "g").collect()}
    assert found == {k: otsu_by_hand(v, np.unique(v)) for k, v in arrays.items()}


def test_otsu_on_reals_is_a_bin_centre(spark):
    values = np.concatenate([np.random.default_rng(5).normal(0, 1, 900), np.random.default_rng(6).normal(9, 1, 100)])
    counts, edges = np.histogram(values, bins=256)
    centres = (edges[:-1] + edges[1:]) / 2
    expected = otsu_by_hand(np.repeat(centres, counts), centres)
    rows = voxel_rows(spark, values.reshape(10, 10, 10), "r").unionAll(
        voxel_rows(spark, np.full((2, 2, 2), 4.5), "flat")
    )
    found = {r.volume_id: r.threshold for r in volume.otsu_threshold_binned(rows).collect()}
    assert found["r"] == pytest.approx(expected)
    assert found["flat"] == 4.5


def test_otsu_mask_is_strict(spark):
    rows = voxel_rows(spark, np.array([[[3, 9, 3, 9]]]), "v", "g", "int")
    mask = volume.segment_above(rows, volume.otsu_threshold(rows, "g"), "g").orderBy("x")
    assert [r.m for r in mask.collect()] == [0, 1, 0, 1]


def test_sweep_counts_each_threshold(spark):
    array = random_volume(8)
    swept = volume.threshold_sweep(voxel_rows(spark, array), [-1.0, 0.3, 2.0]).collect()
    assert {r.threshold: r.foreground_voxels for r in swept} == {t: int((array >= t).sum()) for t in (-1.0, 0.3, 2.0)}


def test_mask_comparison_fills_missing_voxels_with_background(spark):
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 2, (4, 5, 6)), rng.integers(0, 2, (4, 5, 6))
    for dense_rows in (True, False):
        r = volume.compare_masks(mask_rows(spark, a, dense=dense_rows), mask_rows(spark, b, dense=dense_rows)).first()
        tp, fp, fn = int((a & b).sum()), int((a & ~b & 1).sum()), int((~a & 1 & b).sum())
        assert (r.true_positives, r.false_positives, r.false_negatives) == (tp, fp, fn)
        assert r.iou == tp / (tp + fp + fn) and r.dice == 2 * tp / (2 * tp + fp + fn)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7])
def test_float32_edges_match_numpy(spark, threshold):
    values = np.array([0.3, 0.5, 0.7, 0.29999, 0.70001, np.nan], np.float32)
    rows = [("v", 0, 0, i, float(x)) for i, x in enumerate(values)]
    voxels = spark.createDataFrame(rows, "volume_id string, z int, y int, x int, v float")
    expected = int((values >= np.float32(threshold)).sum())
    assert volume.mask_stats(volume.segment(voxels, threshold)).first().foreground_voxels == expected
    assert volume.threshold_sweep(voxels, [threshold]).first().foreground_voxels == expected
    assert volume.stored_limit(threshold, "float32") == float(np.float32(threshold))


def test_ranges_that_are_not_finite_are_refused(spark):
    for odd in (float("nan"), float("inf"), float("-inf")):
        voxels = spark.createDataFrame([("v", 0, 0, i, x) for i, x in enumerate((0.0, 1.0, odd))], "volume_id string, z int, y int, x int, v double")
        with pytest.raises(Exception, match="not finite"):
            volume.histogram(voxels).collect()


def test_real_values_need_bins(spark):
    voxels = spark.createDataFrame([("v", 0, 0, 0, 0.1), ("v", 0, 0, 1, 0.9)], "volume_id string, z int, y int, x int, v double")
    with pytest.raises(Exception, match="whole numbers"):
        volume.otsu_threshold(voxels).collect()


def test_slices_outside_the_table_are_refused(spark):
    voxels = spark.createDataFrame([("v", 0, 0, 0, 0.1)], "volume_id string, z int, y int, x int, v double")
    with pytest.raises(ValueError, match="out of range"):
        volume.take_slice(voxels, 1, 0)
