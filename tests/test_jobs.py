import json
import math

import numpy as np
import pytest

from arrays import parts_and_euler
from binaries import write_stl, write_tiff
from test_concepts import boxes
from test_volume import GOLDEN, GOLDEN_MASK, otsu_by_hand
from tomoloom.plans import jobs


def test_segment_file_writes_a_binary_mask(spark, tmp_path):
    np.save(tmp_path / "ct.npy", GOLDEN)
    out = tmp_path / "results" / "segmentation.npy"
    status = jobs.segment_file(spark, str(tmp_path / "ct.npy"), str(out), 0.5)
    mask = np.load(out)
    assert mask.dtype == np.uint8 and np.array_equal(mask, GOLDEN_MASK)
    assert status["foreground_voxels"] == 4 and status["shape"] == (2, 2, 2)


def test_segment_file_refusals_in_order(spark, tmp_path):
    np.save(tmp_path / "ct.npy", np.zeros((2, 2, 2), "f4"))
    good = str(tmp_path / "ct.npy")
    with pytest.raises(FileNotFoundError, match="input file not found"):
        jobs.segment_file(spark, str(tmp_path / "none.npy"), "mask.tif", math.nan)
    with pytest.raises(ValueError, match=r"threshold must be a finite number \(got nan\)"):
        jobs.segment_file(spark, good, str(tmp_path / "mask.tif"), math.nan)
    with pytest.raises(ValueError, match="^output_filepath must end with '.npy'$"):
        jobs.segment_file(spark, good, str(tmp_path / "mask.tif"), 0.5)
    np.save(tmp_path / "flat.npy", np.zeros((2, 2)))
    with pytest.raises(ValueError, match=r"expected a 3D array, got shape \(2, 2\)"):
        jobs.segment_file(spark, str(tmp_path / "flat.npy"), str(tmp_path / "m.npy"), 0.5)


@pytest.mark.parametrize("suffix", ["npy", "tif"])
def test_slice_file(spark, tmp_path, suffix):
    array = np.arange(60, dtype="u2").reshape(3, 4, 5) ** 2
    path = tmp_path / f"v.{suffix}"
    np.save(path, array) if suffix == "npy" else write_tiff(path, array)
    jobs.slice_file(spark, str(path), str(tmp_path / "out"), 2, axis=1)
    plane = np.take(array, 2, axis=1).astype(float)
    gray = np.floor((plane - plane.min()) / (plane.max() - plane.min()) * 255)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 15 and all(r.gray == gray[r["row"], r["col"]] for r in rows)
    with pytest.raises(ValueError, match="slice_index 4 out of range for axis 1 with size 4"):
        jobs.slice_file(spark, str(path), str(tmp_path / "out"), 4, axis=1)


def test_skeletonise_file(spark, tmp_path):
    mask = np.zeros((7, 7, 7), np.uint8)
    mask[2:5, 2:5, 1:6] = 1
    np.save(tmp_path / "mask.npy", mask)
    out = tmp_path / "results" / "skeleton.npy"
    status = jobs.skeletonise_file(spark, str(tmp_path / "mask.npy"), str(out))
    skeleton = np.load(out)
    assert skeleton.shape == mask.shape and skeleton.dtype == bool
    assert 0 < np.count_nonzero(skeleton) < 45
    assert status["skeleton_voxels"] == np.count_nonzero(skeleton)
    assert np.all(mask[skeleton] == 1)


def test_skeletonise_file_refusals(spark, tmp_path):
    np.save(tmp_path / "empty.npy", np.zeros((3, 3, 3), "u1"))
    (tmp_path / "m.tif").write_bytes(b"")
    empty = str(tmp_path / "empty.npy")
    with pytest.raises(ValueError, match="^input mask has no foreground voxels to skeletonize$"):
        jobs.skeletonise_file(spark, empty, str(tmp_path / "s.npy"))
    with pytest.raises(ValueError, match="input_filepath must reference a '.npy' segmentation mask"):
        jobs.skeletonise_file(spark, str(tmp_path / "m.tif"), str(tmp_path / "s.npy"))
    with pytest.raises(ValueError, match="output_filepath must end with '.npy'"):
        jobs.skeletonise_file(spark, empty, str(tmp_path / "s.tif"))
    np.save(tmp_path / "flat.npy", np.ones((3, 3), "u1"))
    with pytest.raises(ValueError, match="expected a 3D mask"):
        jobs.skeletonise_file(spark, str(tmp_path / "flat.npy"), str(tmp_path / "s.npy"))


def test_explore_folder(spark, tmp_path):
    array = np.random.default_rng(0).integers(0, 900, (3, 4, 5)).astype("u2")
    for name in ("scans", "copies", "meshes", "graphs"):
        (tmp_path / name).mkdir()
    write_tiff(tmp_path / "scans" / "b.tif", array)
    write_tiff(tmp_path / "copies" / "a.tif", array)
    np.save(tmp_path / "scans" / "c.npy", array / 7)
    write_stl(tmp_path / "meshes" / "m.stl", np.zeros((5, 3, 3)))
    (tmp_path / "graphs" / "g.json").write_text(json.dumps({"junctions": [{"position": [0, 0, 1]}], "struts": [1, 2]}))
    (tmp_path / "note").write_text("")
    (tmp_path / "unused").mkdir()
    found = jobs.explore_folder(spark, str(tmp_path))
    report = {(r.section, r.item.rsplit("/")[-1], r.metric): r.value for r in found["report"].collect()}
    assert report["totals", "all", "files"] == 6
    assert report["totals", "all", "volume_files"] == 3
    assert report["extensions", ".tif", "files"] == 2 and report["extensions", "(no ext)", "files"] == 1
    assert report["folders", "copies", "files"] == 1 and report["folders", "unused", "files"] == 0
    assert report["volumes", "duplicate", "volumes"] == 1 and report["volumes", "first", "volumes"] == 2
    assert report["meshes", "m.stl", "n_triangles"] == 5
    assert report["graphs", "g.json", "struts"] == 2 and report["graphs", "g.json", "unit_cells"] == 0
    assert report["volume_stats", "a.tif", "mean_v"] == pytest.approx(array.mean())
    assert report["volume_stats", "c.npy", "max_v"] == (array / 7).max()
    assert ("volume_stats", "b.tif", "mean_v") not in report
    histograms = found["histograms"].orderBy("name", "bin").collect()
    assert sorted({r.name for r in histograms}) == ["copies__a.tif", "scans__c.npy"]
    assert [r.voxels for r in histograms[:200]] == np.histogram(array, bins=200)[0].tolist()
    stored = {r.volume_id: (tuple(r.shape), r.dtype, r.max_v) for r in found["volumes"].collect()}
    assert stored == {
        "copies/a.tif": ((3, 4, 5), "uint16", array.max()),
        "scans/c.npy": ((3, 4, 5), "float64", (array / 7).max()),
    }


def test_explore_a_folder_without_volumes(spark, tmp_path):
    (tmp_path / "note.txt").write_text("x")
    found = jobs.explore_folder(spark, str(tmp_path))
    assert sorted(found) == ["duplicates", "report"] and found["duplicates"].count() == 0


def test_inspect_file(spark, tmp_path):
    # A square ring with a tail of its own thickness, and a small block apart from it.
    solid = np.zeros((9, 24, 40), "f4")
    solid[3:6, 3:18, 3:18] = 0.8
    solid[3:6, 6:15, 6:15] = 0.1
    solid[3:6, 9:12, 15:32] = 0.8
    solid[3:6, 20:23, 34:37] = 0.5
    np.save(tmp_path / "scan.npy", solid)
    found = jobs.inspect_file(spark, str(tmp_path / "scan.npy"), 0.5)
    report = {(r.section, r.metric): r.value for r in found["report"].collect()}
    assert report["segmentation", "foreground_voxels"] == (solid >= 0.5).sum()
    assert report["segmentation", "background_voxels"] == (solid < 0.5).sum()
    assert [report["metadata", n] for n in ("nz", "ny", "nx")] == [9, 24, 40]
    assert (report["connectivity", "parts"], report["connectivity", "euler_number"]) == parts_and_euler(solid >= 0.5)
    assert report["connectivity", "graph_parts"] == 2
    assert all(report["connectivity", n] == 0 for n in ("outside", "unplaced_voxels", "loose_ends"))
    # The ring is one branch from a junction back to it, the tail another one from there to an end.
    kinds = {r.node: r.kind for r in found["nodes"].collect()}
    branches = found["branches"].collect()
    assert report["struts", "struts"] == len(branches) and report["nodes", "junctions"] == 1
    (ring,) = [r for r in branches if r.start == r.end]
    (tail,) = [r for r in branches if r.start != r.end and ring.start in (r.start, r.end)]
    assert {kinds[tail.start], kinds[tail.end]} == {"junction", "end"} and ring.length > tail.length > 8
    np.save(tmp_path / "none.npy", np.zeros((3, 3, 3), "f4"))
    with pytest.raises(ValueError, match="^input mask has no foreground voxels to skeletonize$"):
        jobs.inspect_file(spark, str(tmp_path / "none.npy"), 0.5)


def test_mine_log(spark, tmp_path):
    argument = json.dumps({"search_query": [{"q": "lattice (octet)"}], "find": [{"pattern": "Otsu"}]})
    line = json.dumps({"payload": {"input": f"r = await tools.web__run({argument})"}})
    (tmp_path / "log.jsonl").write_text("\n\n" + line + "\nnot json\n" + line + "\n")
    found = jobs.mine_log(spark, str(tmp_path / "log.jsonl"), str(tmp_path / "blocks")).collect()
    assert [(r.kind, r.line_num, r.text) for r in found] == [("query", 3, "lattice (octet)"), ("pattern", 3, "Otsu")]


def test_as_built_and_designed(spark, tmp_path):
    rng = np.random.default_rng(1)
    array = np.where(rng.random((5, 8, 9)) < 0.3, rng.integers(700, 900, (5, 8, 9)), rng.integers(0, 99, (5, 8, 9))).astype("u2")
    write_tiff(tmp_path / "v.tif", array)
    write_stl(tmp_path / "m.stl", [[[0, 0, 0], [1, 0, 2], [0, 1, 2]], [[0, 0, 5], [1, 0, 6], [0, 1, 6]]])
    out = jobs.as_built_and_designed(spark, str(tmp_path / "v.tif"), str(tmp_path / "m.stl"))
    plane = array[2]
    threshold = out["threshold"].first()["threshold"]
    assert threshold == otsu_by_hand(plane.ravel(), np.unique(plane))
    assert {(r.y, r.x) for r in out["mask"].filter("m = 1").collect()} == {tuple(p) for p in np.argwhere(plane > threshold)}
    r = out["slice"].first()
    assert (r.n_rows, r.n_cols, r.min_v, r.max_v) == (8, 9, plane.min(), plane.max())
    assert out["extent"].first()["z_mid"] == 3.0
    assert out["outline"].count() == 0


def test_literature_heat(spark, tmp_path):
    (tmp_path / "prompt.txt").write_text("Find strut thresholds in CT images")
    page = boxes(spark, {4: [["struts", "ct", "Threshold,", "plain"] * 4, ["empty"]], 5: [["porous", "porous", "metals"]]})
    out = jobs.literature_heat(spark, page, str(tmp_path / "prompt.txt"), (60, 400), sigma=3.0)
    manifest = {(r.doc_id, r.page_no): r.n_hits for r in out["manifest"].filter("section = 'pages'").collect()}
    assert manifest == {(4, 1): 12, (5, 1): 3}
    assert {r.fallback for r in out["hits"].filter("doc_id = 5").collect()} == {True}
    used = {r.doc_id: (r.fallback, r.concepts) for r in out["documents"].collect()}
    assert used == {4: (False, ["find", "strut", "thresholds", "ct", "images"]), 5: (True, ["porous", "metals"])}
    jobs.store_heat(out["heat"], str(tmp_path / "heat"))
    heat = spark.read.parquet(str(tmp_path / "heat")).collect()
    assert {(r.doc_id, r.page_no) for r in heat} == {(4, 1), (5, 1)}
    with pytest.raises(ValueError, match="no documents"):
        jobs.literature_heat(spark, page.filter("doc_id < 0"), str(tmp_path / "prompt.txt"), (60, 400))
    assert all(r.norm >= 0.0999 and 0 <= r.y < 60 and 0 <= r.x < 400 for r in heat)
