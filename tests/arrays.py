"""Small arrays to tables and back, and topology numbers counted without the library."""

import itertools

import numpy as np
import pandas as pd


def voxel_rows(spark, array, volume_id="v", name="v", kind="double"):
    z, y, x = np.indices(array.shape).reshape(3, -1)
    frame = pd.DataFrame(
        {"volume_id": volume_id, "z": z.astype("i4"), "y": y.astype("i4"), "x": x.astype("i4"), name: array.ravel()}
    )
    return spark.createDataFrame(frame, f"volume_id string, z int, y int, x int, {name} {kind}")


def mask_rows(spark, array, volume_id="v", dense=False):
    rows = voxel_rows(spark, array.astype("i1"), volume_id, "m", "tinyint")
    return rows if dense else rows.filter("m <> 0")


def parts_and_euler(mask):
    """Number of 26-connected parts, and the Euler number from counts of the cells of the cubical complex."""
    solid = {tuple(p) for p in np.argwhere(mask)}
    parts, left = 0, set(solid)
    while left:
        parts += 1
        stack = [left.pop()]
        while stack:
            p = stack.pop()
            for step in itertools.product((-1, 0, 1), repeat=3):
                q = tuple(a + b for a, b in zip(p, step))
                if q in left:
                    left.remove(q)
                    stack.append(q)
    cells = {
        tuple(2 * a + 1 + b for a, b in zip(p, step))
        for p in solid
        for step in itertools.product((-1, 0, 1), repeat=3)
    }
    euler = sum((-1) ** sum(c % 2 for c in cell) for cell in cells)
    return parts, euler
