from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame

from tomoloom.operators.skeleton import DIRECTIONS, degree_counts, skeleton_degree, skeletonise, thin_array
from tomoloom.operators.volume import require_foreground

from arrays import mask_rows, parts_and_euler


def thin_whole(array):
    """The same sub-iterations on the undivided array, with no blocks and no Spark."""
    grid = np.pad(array.astype(np.uint8), 1)
    while True:
        before = grid.sum()
        thin_array(grid, (-1, -1, -1), DIRECTIONS)
        if grid.sum() == before:
            return grid[1:-1, 1:-1, 1:-1]


def run(spark, array, **options):
    rows = skeletonise(mask_rows(spark, array), **options).collect()
    out = np.zeros(array.shape, np.uint8)
    for r in rows:
        out[r.z, r.y, r.x] += 1
    assert out.max(initial=0) <= 1
    return out


def shapes():
    block = np.zeros((7, 7, 7), np.uint8)
    block[2:5, 2:5, 1:6] = 1
    ring = np.zeros((9, 15, 15), np.uint8)
    ring[3:6, 3:12, 3:12] = 1
    ring[3:6, 6:9, 6:9] = 0
    cross = np.zeros((9, 21, 21), np.uint8)
    cross[3:6, 9:12, 2:19] = 1
    cross[3:6, 2:19, 9:12] = 1
    rng = np.random.default_rng(5)
    balls = np.zeros((24, 30, 140), np.uint8)
    grid = np.indices(balls.shape)
    for _ in range(14):
        c = [rng.integers(4, n - 4) for n in balls.shape]
        balls[sum((g - k) ** 2 for g, k in zip(grid, c)) <= rng.integers(4, 26)] = 1
    noise = (rng.random((12, 14, 150)) < 0.35).astype(np.uint8)
    return {"block": block, "ring": ring, "cross": cross, "balls": balls, "noise": noise}


@pytest.mark.parametrize("name", shapes())
def test_shape_keeps_its_topology(spark, name):
    mask = shapes()[name]
    skeleton = run(spark, mask, block=64)
    assert 0 < skeleton.sum() < mask.sum()
    assert np.all(mask[skeleton == 1] == 1)
    assert parts_and_euler(skeleton) == parts_and_euler(mask)
    assert np.array_equal(skeleton, thin_whole(mask))


def test_block_is_thinned_to_its_centre_line(spark):
    line = np.argwhere(run(spark, shapes()["block"])).tolist()
    assert line == [[3, 3, x] for x in range(line[0][2], line[-1][2] + 1)]
    assert line[0][2] + line[-1][2] == 6


@pytest.mark.parametrize("directions", [1, 2, 6])
def test_result_does_not_depend_on_the_blocking(spark, directions):
    noise = shapes()["noise"]
    assert np.array_equal(run(spark, noise, block=64, directions_per_exchange=directions), thin_whole(noise))


def test_volumes_that_need_different_numbers_of_passes(spark):
    arrays = {name: shapes()[name] for name in ("block", "ring", "noise")}
    arrays["thick"] = np.pad(np.ones((13, 15, 17), np.uint8), 2)
    arrays["line"] = np.zeros((3, 3, 9), np.uint8)
    arrays["line"][1, 1, 1:8] = 1
    rows = reduce(DataFrame.unionAll, (mask_rows(spark, a, name) for name, a in arrays.items()))
    found = {name: np.zeros_like(a) for name, a in arrays.items()}
    for r in skeletonise(rows).collect():
        found[r.volume_id][r.z, r.y, r.x] += 1
    for name, array in arrays.items():
        assert np.array_equal(found[name], thin_whole(array)), name


def test_negative_values_are_background_but_not_an_empty_mask(spark):
    mask = -np.ones((3, 3, 3), np.int8)
    rows = mask_rows(spark, mask, dense=True)
    require_foreground(rows)
    assert skeletonise(rows).count() == 0


def test_empty_mask_is_refused(spark):
    with pytest.raises(ValueError, match="^input mask has no foreground voxels to skeletonize$"):
        require_foreground(mask_rows(spark, np.zeros((3, 3, 3), np.uint8), dense=True))


def test_degree_of_a_cross(spark):
    mask = np.zeros((3, 7, 7), np.uint8)
    mask[1, 3, :] = 1
    mask[1, :, 3] = 1
    mask[1, 0, 0] = 1
    degrees = skeleton_degree(mask_rows(spark, mask))
    found = {(r.z, r.y, r.x): r.degree for r in degrees.collect()}
    padded = np.pad(mask, 1)
    for z, y, x in np.argwhere(mask):
        assert found[(z, y, x)] == padded[z : z + 3, y : y + 3, x : x + 3].sum() - 1
    kinds = {r.kind: r.voxels for r in degree_counts(degrees).collect()}
    assert kinds["end"] == 4 and kinds["isolated"] == 1
