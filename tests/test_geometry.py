import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrays import mask_rows
from tomoloom.operators import lattice, mesh
from tomoloom.schemas import JUNCTION, STRUT, TRIANGLE


def octet(n, pitch=2.0):
    """Octet truss of n^3 cells: junctions kept per cell, struts shared by cells merged."""
    corners = list(itertools.product((0, 2), repeat=3))
    faces = [p for p in itertools.product((0, 1, 2), repeat=3) if sum(c == 1 for c in p) == 2]
    local = corners + faces
    near = [(a, b) for a, b in itertools.combinations(local, 2) if sum((i - j) ** 2 for i, j in zip(a, b)) == 2]
    junctions, struts = [], set()
    for cell in itertools.product(range(n), repeat=3):
        shift = [c * pitch for c in cell]
        junctions += [tuple(s + c for s, c in zip(shift, p)) for p in local]
        struts |= {
            tuple(s + c for s, c in zip(shift, a)) + tuple(s + c for s, c in zip(shift, b)) for a, b in near
        }
    return junctions, sorted(struts)


def triangles(spark, corners):
    rows = [("m", i, *map(float, np.ravel(t))) for i, t in enumerate(corners)]
    return spark.createDataFrame(rows, TRIANGLE)


def cut_by_hand(corners, plane):
    out = {}
    for i, triangle in enumerate(corners):
        points = []
        for a, b in ((0, 1), (1, 2), (2, 0)):
            p, q = triangle[a], triangle[b]
            if (p[2] > plane) != (q[2] > plane):
                t = (plane - p[2]) / (q[2] - p[2])
                points += [p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])]
        if points:
            out[i] = points
    return out


@pytest.mark.parametrize("plane", [2.0, 2.5, -1.0, 99.0])
def test_cross_section(spark, plane):
    corners = np.random.default_rng(0).integers(0, 5, (200, 3, 3)).astype(float)
    found = {r.tri_id: [r.x0, r.y0, r.x1, r.y1] for r in mesh.cross_section(triangles(spark, corners), plane).collect()}
    assert found == cut_by_hand(corners, plane)


def test_mid_section_uses_each_mesh_s_own_height(spark):
    corners = np.random.default_rng(1).random((50, 3, 3)) * 10
    a = triangles(spark, corners)
    b = triangles(spark, corners + 100).withColumn("mesh_id", F.lit("n"))
    both = a.unionAll(b)
    extent = {r.mesh_id: r for r in mesh.z_range(both).collect()}
    assert extent["m"].n_triangles == 50
    assert (extent["m"].z_min, extent["m"].z_max) == (corners[:, :, 2].min(), corners[:, :, 2].max())
    found = mesh.mid_section(both).filter("mesh_id = 'm'").collect()
    assert {r.tri_id: [r.x0, r.y0, r.x1, r.y1] for r in found} == cut_by_hand(corners, extent["m"].z_mid)


@pytest.mark.parametrize(("n", "junctions", "struts"), [(1, 14, 36), (8, 7168, 13056), (9, 10206, 18468)])
def test_octet_lattice_counts(spark, n, junctions, struts):
    points, bars = octet(n)
    profile = lattice.graph_profile(
        spark.createDataFrame([("g", i, *p) for i, p in enumerate(points)], JUNCTION),
        spark.createDataFrame([("g", i, *b) for i, b in enumerate(bars)], STRUT),
        spark.range(n**3).select(F.lit("g").alias("graph_id")),
    ).first()
    assert (profile.junctions, profile.struts, profile.unit_cells) == (junctions, struts, n**3)
    assert [profile[f"min_{d}"] for d in "xyz"] == [0, 0, 0]
    assert [profile[f"max_{d}"] for d in "xyz"] == [2.0 * n] * 3


def test_graph_without_junctions_has_no_box(spark):
    none = spark.createDataFrame([], JUNCTION)
    bars = spark.createDataFrame([("g", 0, *[0.0] * 6)], STRUT)
    profile = lattice.graph_profile(none, bars, none.select("graph_id")).first()
    assert (profile.junctions, profile.struts, profile.min_x) == (0, 1, None)


def test_missing_and_broken_struts(spark):
    mask = np.zeros((4, 12, 12), np.uint8)
    mask[1, 2, 1:11] = 1
    mask[1, 6, 1:5] = 1
    struts = spark.createDataFrame(
        [("v", i, 1.0, y, 1.0, 10.0, y, 1.0) for i, y in enumerate((2.0, 6.0, 9.0))], STRUT
    )
    coverage = lattice.strut_coverage(struts, mask_rows(spark, mask))
    found = {r.strut_id: (r.voxels, r.filled, r.missing, r.broken) for r in coverage.collect()}
    assert found == {0: (10, 10, False, False), 1: (10, 4, False, True), 2: (10, 0, True, False)}
    defects = lattice.strut_defects(coverage).first()
    assert (defects.struts, defects.missing, defects.broken) == (3, 1, 1)
    assert defects.missing_percent == pytest.approx(100 / 3)


def test_node_degree_of_an_octet_cell(spark):
    _, bars = octet(1)
    degrees = lattice.node_degree(spark.createDataFrame([("g", i, *b) for i, b in enumerate(bars)], STRUT))
    found = {(r.x, r.y, r.z): r.degree for r in degrees.collect()}
    assert found[0.0, 0.0, 0.0] == 3 and found[1.0, 1.0, 0.0] == 8
    assert sum(found.values()) == 2 * len(bars)


def test_gaps_in_long_struts_are_seen(spark):
    mask = np.ones((1, 1, 101), np.uint8)
    mask[0, 0, 31:52] = 0
    struts = spark.createDataFrame([("v", 1, 0.0, 0.0, 0.0, 100.0, 0.0, 0.0), ("v", 2, 5.0, 0.0, 0.0, 5.0, 0.0, 0.0)], STRUT)
    found = {r.strut_id: (r.voxels, r.filled, r.broken) for r in lattice.strut_coverage(struts, mask_rows(spark, mask)).collect()}
    assert found == {1: (101, 80, True), 2: (1, 1, False)}
