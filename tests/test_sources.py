import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from binaries import write_stl, write_tiff
from tomoloom.operators import lattice
from tomoloom.functions.paths import open_file
from tomoloom.sources import explode_lines, read_voxels, register
from tomoloom.sources.headers import lines_of, volume_headers
from tomoloom.sources.tiff import Page, read_directory
from tomoloom.plans.jobs import read_volume, store_voxels, volume_shape
from tomoloom.sources.files import digest_tree, list_tree, log_lines, number_lines, read_lattice_json, read_prompt, read_prompts
from tomoloom.sources.stl import header_count, stl_counts


def to_array(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows.collect():
        out[r.z, r.y, r.x] = r.v
    return out


@pytest.fixture
def array():
    return np.random.default_rng(0).integers(0, 65_536, (7, 5, 6)).astype("u2")


def test_npy_volume_by_slab(spark, tmp_path, array):
    np.save(tmp_path / "v.npy", array)
    rows = read_voxels(spark, "npy_volume", str(tmp_path / "v.npy"), slab=2)
    assert rows.rdd.getNumPartitions() == 4
    assert np.array_equal(to_array(rows, array.shape), array)


@pytest.mark.parametrize("dtype", ["f4", "f8", "i4", "u1", "bool"])
@pytest.mark.parametrize("fortran", [False, True])
def test_npy_dtypes_and_layouts(spark, tmp_path, dtype, fortran):
    array = (np.random.default_rng(1).random((3, 4, 5)) * 3).astype(dtype)
    np.save(tmp_path / "v.npy", np.asfortranarray(array) if fortran else array)
    assert np.array_equal(to_array(read_volume(spark, str(tmp_path / "v.npy")), array.shape), array.astype("f8"))


@pytest.mark.parametrize("kind", ["npy", "tif"])
def test_plane_filter_plans_one_partition(spark, tmp_path, array, kind):
    path = tmp_path / f"v.{kind}"
    if kind == "npy":
        np.save(path, array)
        rows = read_voxels(spark, "npy_volume", str(path), slab=1)
    else:
        write_tiff(path, array)
        rows = read_voxels(spark, "tiff_stack", str(path), pages=1)
    assert rows.rdd.getNumPartitions() == 7
    one = rows.filter("z = 3")
    assert one.rdd.getNumPartitions() == 1
    assert sorted(r.v for r in one.collect()) == sorted(array[3].ravel())
    some = rows.filter("z >= 2 and z < 5")
    assert some.rdd.getNumPartitions() == 3 and some.count() == 3 * 30
    assert rows.filter("z > 6").count() == 0


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("dtype", ["u1", "u2", "i4", "f4", "f8"])
def test_tiff_stack(spark, tmp_path, order, dtype):
    array = (np.random.default_rng(2).random((4, 5, 3)) * 200).astype(dtype)
    write_tiff(tmp_path / "v.TIFF", array, order)
    assert volume_shape(str(tmp_path / "v.TIFF")) == array.shape
    assert np.array_equal(to_array(read_volume(spark, str(tmp_path / "v.TIFF")), array.shape), array.astype("f8"))


LAYOUTS = [
    {"compression": code, "predictor": predictor, "tile": tile, "order": order}
    for code in (1, 5, 8, 32946, 32773)
    for predictor, tile, order in ((1, None, "<"), (2, None, ">"), (2, (16, 16), "<"), (1, (16, 32), ">"))
]


@pytest.mark.parametrize("layout", LAYOUTS, ids=lambda o: "-".join(map(str, o.values())))
def test_tiff_layouts(tmp_path, layout):
    rng = np.random.default_rng(7)
    # Long even stretches and noise, and so many kinds of pairs that the widest codes and a cleared table occur.
    array = np.concatenate([rng.integers(0, 1 << 16, (1, 70, 45)), rng.integers(7, 9, (1, 70, 45)), np.full((1, 70, 45), 300)]).astype("u2")
    write_tiff(tmp_path / "v.tif", array, rows_per_strip=33, **layout)
    pages = read_directory(str(tmp_path / "v.tif"))
    with open_file(str(tmp_path / "v.tif")) as handle:
        assert all(np.array_equal(page.read(handle), plane) for page, plane in zip(pages, array, strict=True))
        assert [Page.from_row(p.row()) for p in pages] == pages


def test_compressed_tiles_through_headers(spark, tmp_path):
    arrays = {f"v{k}.tif": np.random.default_rng(k).integers(0, 9, (3, 20, 30)).astype("i4") for k in range(3)}
    for k, (name, array) in enumerate(arrays.items()):
        write_tiff(tmp_path / name, array, compression=(5, 8, 32773)[k], predictor=2, tile=(16, 16))
    np.save(tmp_path / "v.npy", arrays["v0.tif"])
    listed = spark.createDataFrame([(str(p),) for p in tmp_path.iterdir()], "path string")
    headers = volume_headers(listed)
    rows = {r.path: (r.kind, tuple(r.shape), r.dtype) for r in spark.read.parquet(headers).collect()}
    assert rows[str(tmp_path / "v.npy")] == ("npy_volume", (3, 20, 30), "int32") and len(rows) == 4
    for kind, names in (("tiff_stack", list(arrays)), ("npy_volume", ["v.npy"])):
        voxels = explode_lines(lines_of(spark, headers, kind))
        for name in names:
            one = voxels.filter(F.col("volume_id") == str(tmp_path / name))
            assert np.array_equal(to_array(one, (3, 20, 30)), arrays.get(name, arrays["v0.tif"]))
        assert voxels.filter("z = 1").count() == 600 * len(names)
    with pytest.raises(Exception, match="Unsupported file type '.raw'"):
        volume_headers(spark.createDataFrame([(str(tmp_path / "flat.raw"),)], "path string"))


def test_unknown_tiff_layouts_are_refused(tmp_path, array):
    write_tiff(tmp_path / "v.tif", array, compression=7)
    with pytest.raises(ValueError, match="unsupported TIFF compression 7"):
        volume_shape(str(tmp_path / "v.tif"))
    write_tiff(tmp_path / "v.tif", array.astype("f4"), predictor=2)
    with pytest.raises(ValueError, match="unsupported TIFF predictor 2"):
        volume_shape(str(tmp_path / "v.tif"))


def test_unknown_suffix_and_rank(spark, tmp_path):
    (tmp_path / "v.raw").write_bytes(b"x")
    with pytest.raises(ValueError, match=r"^Unsupported file type '.raw'. Expected .npy, .tif, or .tiff.$"):
        volume_shape(str(tmp_path / "v.raw"))
    np.save(tmp_path / "flat.npy", np.zeros((2, 2)))
    with pytest.raises(ValueError, match=r"expected a 3D array, got shape \(2, 2\)"):
        read_volume(spark, str(tmp_path / "flat.npy"))


def test_npy_writer_places_voxels_from_many_tasks(spark, tmp_path, array):
    np.save(tmp_path / "v.npy", array)
    rows = read_volume(spark, str(tmp_path / "v.npy")).repartition(5, "x", "y")
    out = str(tmp_path / "sub" / "copy.npy")
    options = {"shape": "7,5,6", "dtype": "uint16"}
    rows.write.format("npy_volume").options(**options).mode("overwrite").save(out)
    copy = np.load(out)
    assert copy.dtype == np.uint16 and np.array_equal(copy, array)
    sparse = rows.filter("v > 30000")
    sparse.write.format("npy_volume").options(**options).mode("overwrite").save(out)
    assert np.array_equal(np.load(out), np.where(array > 30000, array, 0))
    lines = spark.read.format("npy_volume").option("slab", 2).load(str(tmp_path / "v.npy")).repartition(3, "y")
    lines.write.format("npy_volume").options(**options).mode("overwrite").save(out)
    assert np.array_equal(np.load(out), array)
    assert [p.name for p in (tmp_path / "sub").iterdir()] == ["copy.npy"]


def test_npy_writer_needs_the_suffix(spark, tmp_path, array):
    np.save(tmp_path / "v.npy", array)
    rows = read_volume(spark, str(tmp_path / "v.npy"))
    with pytest.raises(Exception, match="output_filepath must end with '.npy'"):
        rows.write.format("npy_volume").option("shape", "7,5,6").mode("overwrite").save(str(tmp_path / "mask.tif"))


def test_parquet_sink_is_partitioned_by_slab(spark, tmp_path):
    array = np.random.default_rng(3).random((70, 2, 2))
    np.save(tmp_path / "v.npy", array)
    rows = read_volume(spark, str(tmp_path / "v.npy")).withColumn("volume_id", F.lit("scan"))
    store_voxels(rows, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out" / "volume_id=scan").iterdir()) == [f"z_slab={i}" for i in range(3)]
    assert np.array_equal(to_array(spark.read.parquet(str(tmp_path / "out")), array.shape), array)


def test_stl_mesh(spark, tmp_path):
    corners = np.random.default_rng(4).random((11, 3, 3)).astype("f4")
    write_stl(tmp_path / "a.stl", corners)
    rows = spark.read.format("stl_mesh").option("records", 4).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3
    for r in rows.collect():
        found = [[r[f"{v}{d}"] for d in "xyz"] for v in "abc"]
        assert np.array_equal(np.float32(found), corners[r.tri_id])
    assert rows.count() == 11


def test_stl_count_trusts_the_header_but_the_reader_does_not(spark, tmp_path):
    write_stl(tmp_path / "short.stl", np.zeros((2, 3, 3)), count=3_514_642)
    path = str(tmp_path / "short.stl")
    assert header_count(path) == 3_514_642
    listing = spark.createDataFrame([(path,)], "path string")
    assert stl_counts(listing).first()["n_triangles"] == 3_514_642
    with pytest.raises(Exception, match="shorter than the 3514642 triangles"):
        spark.read.format("stl_mesh").load(path).count()


def test_lattice_json_with_missing_lists(spark, tmp_path):
    full = {
        "junctions": [{"position": [0, 1.5, 2], "id": 4}, {"position": [3, -1, 9]}],
        "struts": [[0, 1], {"from": 0}],
        "unit_cells": ["c"],
        "extra": {"a": 1},
    }
    (tmp_path / "full.json").write_text(json.dumps(full, indent=2))
    (tmp_path / "bare.json").write_text("{}")
    found = {r.graph_id.rsplit("/")[-1]: r for r in lattice.json_profile(read_lattice_json(spark, str(tmp_path))).collect()}
    r = found["full.json"]
    assert (r.junctions, r.struts, r.unit_cells) == (2, 2, 1)
    assert (r.min_x, r.min_y, r.min_z, r.max_x, r.max_y, r.max_z) == (0, -1, 2, 3, 1.5, 9)
    r = found["bare.json"]
    assert (r.junctions, r.struts, r.unit_cells, r.min_x) == (0, 0, 0, None)


def test_listing_and_digests(spark, tmp_path):
    contents = {"a/x.tif": b"one", "a/b/y.NPY": b"one", "top.txt": b"", "c d/z z.json": b"x" * 100}
    for name, data in contents.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    listing = {r.path: r.length for r in list_tree(spark, str(tmp_path)).collect()}
    assert listing == {name: len(data) for name, data in contents.items()}
    digests = {r.path: r.content_md5 for r in digest_tree(spark, str(tmp_path)).collect()}
    assert digests == {name: hashlib.md5(data).hexdigest() for name, data in contents.items()}
    plan = list_tree(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in plan


def test_the_driver_names_no_file_of_a_tree(spark, tmp_path):
    """300 files in 3 folders, one of them empty but for folders; hidden names are passed over, odd ones are not."""
    names = [f"{folder}/deep/f{k}.txt" for folder in ("a", "b%20c") for k in range(150)] + ["d=1/_x=2/é #1.txt", "_metadata"]
    for name in [*names, ".hidden", "_gone/f.txt", "a/.crc", "a/half._COPYING_"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * (len(name) % 3))
    (tmp_path / "nothing").mkdir()
    listing = list_tree(spark, str(tmp_path))
    assert len(listing.inputFiles()) < 30
    assert sorted((r.path, r.length) for r in listing.collect()) == sorted((n, len(n) % 3) for n in names)
    assert {r.path: r.content_md5 for r in digest_tree(spark, str(tmp_path)).collect()} == {
        n: hashlib.md5(b"x" * (len(n) % 3)).hexdigest() for n in names
    }
    assert list_tree(spark, str(tmp_path / "nothing")).collect() == []


def test_line_numbers_over_many_splits(spark, tmp_path):
    rng = np.random.default_rng(5)
    expected = {}
    for name in ("a.jsonl", "b.jsonl"):
        lines = ["" if rng.random() < 0.2 else f"{name} " + "x" * int(rng.integers(0, 60)) + str(i) for i in range(400)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        expected |= {(name, i): line for i, line in enumerate(lines, start=1)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        lines = log_lines(spark, str(tmp_path))
        log = number_lines(lines, lines)
        assert log.select("file").distinct().count() == 2
        found = {(r.file.rsplit("/")[-1], r.line_num): r.line for r in log.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == expected


def test_prompt_file_is_one_row(spark, tmp_path):
    (tmp_path / "p.txt").write_text("two\nlines ünï\n", encoding="utf-8")
    rows = read_prompt(spark, str(tmp_path / "p.txt")).collect()
    assert [r.value for r in rows] == ["two\nlines ünï\n"]


def test_volumes_are_read_where_no_filter_is_pushed_down(spark, tmp_path):
    # Spark refuses a reader that takes filters in a session that pushes none; the driver's session is such a one.
    np.save(tmp_path / "v.npy", np.arange(60.0).reshape(5, 3, 4))
    setting = "spark.sql.python.filterPushdown.enabled"
    for pushed in ("false", "true"):
        spark.conf.set(setting, pushed)
        register(spark)
        rows = read_voxels(spark, "npy_volume", str(tmp_path / "v.npy"), slab=1)
        assert [r.v for r in rows.filter("z = 3 and y = 1").orderBy("x").collect()] == [40.0, 41.0, 42.0, 43.0]
        plane = read_voxels(spark, "npy_volume", str(tmp_path / "v.npy"), slab=1, z_from=2, z_to=4)
        assert plane.rdd.getNumPartitions() == 2 and {r.z for r in plane.collect()} == {2, 3}


def test_many_prompt_files_take_few_tasks(spark, tmp_path):
    # Spark's own reader counts 4 MB for the opening of a file, so a task for every 32 files.
    for k in range(400):
        (tmp_path / f"p {k}.txt").write_text(f"two\nlines ünï {k}", encoding="utf-8")
    paths = spark.createDataFrame([(f"{start}{tmp_path}/p {k}.txt",) for k, start in zip(range(400), ["", "file:"] * 200)], "path string")
    prompts = read_prompts(paths)
    assert prompts.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert sorted(r.value for r in prompts.collect()) == sorted(f"two\nlines ünï {k}" for k in range(400))
