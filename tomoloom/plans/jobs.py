"""Whole jobs on files: the tool functions and scripts a user runs end to end."""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoloom.functions.storage import materialize
from tomoloom.operators import concepts, heat, inventory, lattice, logs, mesh, skeleton, topology, volume
from tomoloom.plans import reports
from tomoloom.sources import explode_lines
from tomoloom.sources.files import (
    digest_tree,
    list_tree,
    log_lines,
    number_lines,
    read_lattice_json,
    read_prompt,
    top_folders,
)
from tomoloom.sources.headers import HEADER, lines_of, volume_headers
from tomoloom.sources.npy import npy_shape
from tomoloom.sources.stl import stl_counts
from tomoloom.sources.tiff import read_directory

SLAB = 32


def volume_shape(path: str) -> tuple[int, ...]:
    return volume_header(path)[0]


def volume_header(path: str) -> tuple[tuple[int, ...], str]:
    """Shape and stored type of a volume file from its header or page directories."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"input file not found at {path}")
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".npy":
        shape, dtype = npy_shape(path)
        return shape, dtype.name
    if suffix in (".tif", ".tiff"):
        pages = read_directory(path)
        return (len(pages), *pages[0].shape), np.dtype(pages[0].dtype).name
    raise ValueError(f"Unsupported file type '{suffix}'. Expected .npy, .tif, or .tiff.")


def read_lines(spark: SparkSession, path: str, plane: int | None = None) -> DataFrame:
    """Lines of one volume file, or of one of its planes only, after checking that it is 3D."""
    volume.check_rank(volume_shape(path))
    of = {} if plane is None else {"z_from": str(plane), "z_to": str(plane + 1)}
    return spark.read.format("npy_volume" if path.lower().endswith(".npy") else "tiff_stack").options(**of).load(path)


def read_volume(spark: SparkSession, path: str, plane: int | None = None) -> DataFrame:
    return explode_lines(read_lines(spark, path, plane))


def _require_npy(path: str, message: str) -> None:
    if os.path.splitext(path)[1].lower() != ".npy":
        raise ValueError(message)


def _write_npy(table: DataFrame, path: str, shape: Sequence[int], dtype: str) -> None:
    options = {"shape": ",".join(map(str, shape)), "dtype": dtype}
    table.write.format("npy_volume").options(**options).mode("overwrite").save(path)


def segment_file(spark: SparkSession, input_path: str, output_path: str, threshold: float) -> dict:
    """Threshold a `.npy` volume into a 0/1 `.npy` mask; returns shape and foreground count."""
    if not os.path.isfile(input_path):
        raise FileNotFoundError(f"input file not found at {input_path}")
    volume.check_threshold(threshold)
    _require_npy(output_path, "output_filepath must end with '.npy'")
    shape, dtype = volume_header(input_path)
    volume.check_rank(shape)
    mask = volume.segment_lines(read_lines(spark, input_path), threshold, dtype)
    _write_npy(mask, output_path, shape, "uint8")
    solid = F.size(F.filter("run", lambda v: v != 0))
    found = read_lines(spark, output_path).agg(F.coalesce(F.sum(solid), F.lit(0)).alias("n")).first()["n"]
    return {"output": output_path, "threshold": threshold, "shape": shape, "foreground_voxels": found}


def slice_file(spark: SparkSession, input_path: str, output_path: str, index: int, axis: int = 0) -> dict:
    """One slice of a volume as a table of gray pixels `(row, col, gray)`."""
    shape = volume_shape(input_path)
    volume.check_rank(shape)
    volume.check_slice(shape, index, axis)
    voxels = read_volume(spark, input_path, index if axis == 0 else None)
    plane = volume.take_slice(voxels, index, axis, shape=shape)
    volume.gray_levels(plane).write.mode("overwrite").parquet(output_path)
    return {"output": output_path, "slice_index": index, "axis": axis}


def skeletonise_file(spark: SparkSession, input_path: str, output_path: str) -> dict:
    """Thin a `.npy` mask to a boolean `.npy` skeleton of the same shape."""
    if not os.path.isfile(input_path):
        raise FileNotFoundError(f"input file not found at {input_path}")
    _require_npy(input_path, "input_filepath must reference a '.npy' segmentation mask")
    _require_npy(output_path, "output_filepath must end with '.npy'")
    shape = volume_shape(input_path)
    volume.check_rank(shape, "mask")
    mask = read_volume(spark, input_path)
    volume.require_foreground(mask, "v")
    thin = materialize(skeleton.skeletonise(mask, value="v"))
    _write_npy(thin.withColumn("m", F.lit(1).cast("tinyint")), output_path, shape, "bool")
    return {"output": output_path, "shape": shape, "skeleton_voxels": thin.count()}


def inspect_file(spark: SparkSession, input_path: str, threshold: float) -> dict[str, DataFrame]:
    """Inspection report of a scan file: threshold, skeleton and strut graph, in one tidy table.

    Besides the `report`, the `skeleton` voxels and the graph's `nodes` and `branches`. Sections are the volume's metadata,
    its segmentation, the skeleton's connectivity, and what the strut graph holds.
    """
    volume.check_threshold(threshold)
    shape, dtype = volume_header(input_path)
    volume.check_rank(shape)
    lines = read_lines(spark, input_path)
    mask = materialize(explode_lines(volume.segment_lines(lines, threshold, dtype)).withColumnRenamed("v", "m").filter("m <> 0"))
    if mask.isEmpty():
        raise ValueError("input mask has no foreground voxels to skeletonize")
    thin = materialize(skeleton.skeletonise(mask))
    nodes, branches = topology.skeleton_graph(thin)
    total = int(np.prod(shape))
    counted = mask.groupBy("volume_id").agg(F.count(F.lit(1)).alias("foreground_voxels"))
    stats = counted.withColumn("background_voxels", F.lit(total) - F.col("foreground_voxels"))
    struts = branches.groupBy("volume_id").agg(
        F.count(F.lit(1)).alias("struts"), F.sum("length").alias("total_length"), F.max("length").alias("longest")
    )
    ends = topology.graph_summary(nodes, branches).select("volume_id", "junctions", "ends", "isolated", "closed")
    sections = {
        "metadata": (volume.profile(explode_lines(lines)), "volume_id", ["nz", "ny", "nx", "n_voxels", "min_v", "max_v", "mean_v"]),
        "segmentation": (stats, "volume_id", ["foreground_voxels", "background_voxels"]),
        "connectivity": (reports.connectivity(mask, thin, (nodes, branches)), "volume_id", reports.CONNECTIVITY),
        "struts": (struts, "volume_id", ["struts", "total_length", "longest"]),
        "nodes": (ends, "volume_id", ["junctions", "ends", "isolated", "closed"]),
    }
    return {"report": reports.nde_report(sections), "skeleton": thin, "nodes": nodes, "branches": branches}


def store_voxels(table: DataFrame, path: str) -> None:
    """Write a voxel, mask or skeleton table partitioned by volume and slab, each slab in scan order."""
    slabbed = table.withColumn("z_slab", F.floor(F.col("z") / SLAB).cast("int"))
    (
        slabbed.repartition("volume_id", "z_slab")
        .sortWithinPartitions("volume_id", "z_slab", "z", "y", "x")
        .write.partitionBy("volume_id", "z_slab")
        .mode("overwrite")
        .parquet(path)
    )


def explore_folder(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Inventory report of a data folder, pairs of duplicate volumes, and the 200-bin histogram of each distinct one.

    `volumes` gives each distinct one's shape and stored type, from its header, with its least, largest and mean value.
    Duplicate volumes are hashed but neither profiled nor counted into bins. `histograms` names each one by its path
    with `__` for the separators.
    """
    digests = materialize(digest_tree(spark, root))
    volumes = inventory.duplicates(inventory.volume_files(inventory.describe_files(digests)))
    located = list_tree(spark, root).select("path", F.regexp_replace("full_path", "^file:", "").alias("volume_id"))
    firsts = materialize(volumes.filter(~F.col("is_duplicate")).select("path", "ext").join(located, "path"))
    headers = volume_headers(firsts, "volume_id")
    kinds = [row.kind for row in spark.read.schema(HEADER).parquet(headers).select("kind").distinct().collect()]
    scans = [explode_lines(lines_of(spark, headers, kind)) for kind in sorted(kinds)]
    names = firsts.select("volume_id", "path")

    def named(result: DataFrame) -> DataFrame:
        return result.join(names, "volume_id").drop("volume_id").withColumnRenamed("path", "volume_id")

    listing = inventory.describe_files(list_tree(spark, root))
    graphs = None
    if not listing.filter("ext = '.json'").isEmpty():
        graphs = lattice.json_profile(read_lattice_json(spark, root))
    meshes = stl_counts(listing.filter("ext = '.stl'").select(F.col("full_path").alias("path")))
    meshes = meshes.withColumnRenamed("path", "mesh_id")
    voxels = reports.stack(scans) if scans else None
    stats = named(volume.profile(voxels)) if scans else None
    stored = named(spark.read.schema(HEADER).parquet(headers).select(F.col("path").alias("volume_id"), "shape", "dtype"))
    found = {
        "report": reports.inventory_report(digests, stats, graphs, meshes, top_folders(spark, root)),
        "duplicates": volumes.filter("is_duplicate").select("path", "first_path"),
    }
    if scans:
        found["volumes"] = stored.join(stats.select("volume_id", "min_v", "max_v", "mean_v"), "volume_id")
        bins = named(volume.histogram(voxels))
        found["histograms"] = bins.withColumn("name", F.replace("volume_id", F.lit("/"), F.lit("__")))
    return found


def mine_log(spark: SparkSession, log_path: str, output_path: str | None = None) -> DataFrame:
    """Keywords of an agent log in first-seen order with their line numbers, optionally written as blocks."""
    lines = log_lines(spark, log_path)
    found = materialize(logs.keywords(lines))
    if output_path:
        logs.write_keyword_blocks(found, output_path)
    return logs.in_order(number_lines(found, lines))


def as_built_and_designed(spark: SparkSession, volume_path: str, mesh_path: str) -> dict[str, DataFrame]:
    """Middle scan slice with its Otsu mask, and the mesh outline at mid-height; the two are not registered."""
    shape, dtype = volume_header(volume_path)
    middle = shape[0] // 2
    plane = read_volume(spark, volume_path, middle)
    triangles = spark.read.format("stl_mesh").load(mesh_path)
    whole = np.issubdtype(np.dtype(dtype), np.integer) or dtype == "bool"
    threshold = volume.otsu_threshold(plane) if whole else volume.otsu_threshold_binned(plane)
    return {
        "slice": volume.slice_range(volume.take_slice(plane, middle, shape=shape)),
        "threshold": threshold,
        "mask": volume.segment_above(plane, threshold),
        "extent": mesh.z_range(triangles),
        "outline": mesh.mid_section(triangles),
    }


def literature_heat(
    spark: SparkSession,
    boxes: DataFrame,
    prompt_path: str,
    page_size: tuple[int, int] | DataFrame,
    min_hits: int = concepts.MIN_HITS,
    sigma: float = heat.SIGMA,
    full_red_hits: float = heat.FULL_RED_HITS,
    max_pages: int | None = None,
) -> dict[str, DataFrame]:
    """Hits, ranked pages, concepts used and coloured heat of every document for one prompt.

    `page_size` is (height, width) in pixels, or a table `(doc_id, page_no, height, width)` where pages differ.
    """
    if boxes.isEmpty():
        raise ValueError("no documents to search")
    wanted = materialize(concepts.prompt_concepts(read_prompt(spark, prompt_path)).select("ord", "concept"))
    documents = concepts.resolve_documents(boxes, wanted, min_hits, max_pages)
    hits = materialize(concepts.resolved_hits(boxes, wanted, min_hits, max_pages=max_pages, documents=documents))
    size, placed = page_size, hits
    if isinstance(page_size, DataFrame):
        size, placed = ("height", "width"), hits.join(page_size, ["doc_id", "page_no"])
    splats = materialize(heat.splat(placed, *size))
    grid = heat.blur(splats, *size, sigma=sigma, above=heat.visible_heat(sigma, full_red_hits))
    return {
        "hits": hits,
        "documents": concepts.concepts_used(boxes, wanted, documents),
        "manifest": reports.literature_manifest(heat.page_heat_totals(hits, splats, keep_cold=True)),
        "heat": heat.with_colour(heat.with_alpha(grid, sigma, full_red_hits)),
    }


def store_heat(heat_pixels: DataFrame, path: str) -> None:
    """Write heat pixels so that each page lies together, in scan order."""
    paged = heat_pixels.repartition("doc_id", "page_no").sortWithinPartitions("doc_id", "page_no", "y", "x")
    paged.write.mode("overwrite").parquet(path)
