"""Tidy report tables: one row per number, `(section, item, metric, value)`."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomoloom.functions.storage import materialize
from tomoloom.functions.text import slug
from tomoloom.operators import concepts, inventory, topology


def tidy(frame: DataFrame, section: str, item: str, metrics: list[str]) -> DataFrame:
    """Turn the metric columns of a table into rows; null metrics give none."""
    pairs = F.array(
        *(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)
    )
    return frame.select(
        F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), F.inline(pairs)
    ).filter(F.col("value").isNotNull())


def stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def inventory_report(
    files: DataFrame,
    volume_stats: DataFrame | None = None,
    graphs: DataFrame | None = None,
    meshes: DataFrame | None = None,
    all_folders: DataFrame | None = None,
) -> DataFrame:
    """Counts of files, extensions, folders and duplicate volumes, with graph, mesh and volume numbers where given.

    Graphs come with the box around their junctions.

    `files` has `path` and `content_md5`. Volumes that repeat an earlier one appear as duplicates only.
    `all_folders` (`folder`) brings in folders without files.
    """
    described = inventory.describe_files(files)
    volumes = inventory.duplicates(inventory.volume_files(described))
    totals = described.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("ext") == ".json").alias("json_files"),
        F.count_if(F.col("ext") == ".stl").alias("stl_files"),
        F.count_if(F.col("ext").isin(*inventory.VOLUME_EXTENSIONS)).alias("volume_files"),
    ).withColumn("item", F.lit("all"))
    in_folders = described.filter(F.col("folder").isNotNull()).groupBy("folder").agg(
        F.count(F.lit(1)).alias("files")
    )
    if all_folders is not None:
        in_folders = all_folders.join(in_folders, "folder", "left").fillna(0, ["files"])
    n_folders = in_folders.agg(F.count(F.lit(1)).alias("folders")).withColumn("item", F.lit("all"))
    kinds = volumes.groupBy(F.when(F.col("is_duplicate"), "duplicate").otherwise("first").alias("kind")).agg(
        F.count(F.lit(1)).alias("volumes")
    )
    parts = [
        tidy(totals, "totals", "item", ["files", "json_files", "stl_files", "volume_files"]),
        tidy(n_folders, "totals", "item", ["folders"]),
        tidy(inventory.extension_counts(described), "extensions", "ext", ["files"]),
        tidy(in_folders, "folders", "folder", ["files"]),
        tidy(kinds, "volumes", "kind", ["volumes"]),
    ]
    if graphs is not None:
        box = [f"{end}_{axis}" for end in ("min", "max") for axis in "xyz"]
        parts.append(tidy(graphs, "graphs", "graph_id", ["junctions", "struts", "unit_cells", *box]))
    if meshes is not None:
        parts.append(tidy(meshes, "meshes", "mesh_id", ["n_triangles"]))
    if volume_stats is not None:
        parts.append(
            tidy(volume_stats, "volume_stats", "volume_id", ["nz", "ny", "nx", "min_v", "max_v", "mean_v"])
        )
    return stack(parts)


def literature_manifest(pages: DataFrame, top: int = 10) -> DataFrame:
    """Every page ranked inside its document, and the strongest pages over all documents in section `strongest`."""
    pages = materialize(pages)
    ranked = concepts.rank_pages(pages).withColumn("section", F.lit("pages"))
    order = Window.orderBy(F.desc("n_hits"), "doc_id", "page_no")
    strongest = (
        concepts.top_pages(pages, top)
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .withColumn("section", F.lit("strongest"))
    )
    manifest = strongest.unionByName(ranked)
    return manifest.withColumn("file", concepts.heat_file_name(F.col("page_no")))


def name_documents(manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """Add each document's `path` and output folder name; `documents` is `(doc_id, path)`."""
    named = documents.select("doc_id", "path", slug(F.col("path")).alias("folder"))
    return manifest.join(named, "doc_id").withColumn("file", F.concat_ws("/", "folder", "file"))


def strut_graph(skeleton: DataFrame, nodes: DataFrame, branches: DataFrame) -> DataFrame:
    """(volume_id, parts, unplaced_voxels, loose_ends, half_branches) of a skeleton's graph; the last three are 0 if it is whole.

    Every voxel lies in a node or is a link, every end has one branch, and a branch has two nodes or none.
    """
    voxels = skeleton.groupBy("volume_id").agg(F.count(F.lit(1)).alias("_voxels"))
    summary = topology.graph_summary(nodes, branches)
    ends = branches.select("volume_id", F.explode(F.array("start", "end")).alias("node")).groupBy("volume_id", "node").agg(
        F.count(F.lit(1)).alias("_branches")
    )
    loose = (
        nodes.filter("kind = 'end'")
        .join(ends, ["volume_id", "node"], "left")
        .groupBy("volume_id")
        .agg(F.count_if(F.coalesce("_branches", F.lit(0)) != 1).alias("_loose"))
    )
    half = branches.groupBy("volume_id").agg(F.count_if(F.col("start").isNotNull() != F.col("end").isNotNull()).alias("_half"))
    joined = voxels.join(summary, "volume_id").join(loose, "volume_id", "left").join(half, "volume_id", "left")
    return joined.select(
        "volume_id",
        "parts",
        (F.col("_voxels") - F.col("node_voxels") - F.col("links")).alias("unplaced_voxels"),
        F.coalesce("_loose", F.lit(0)).alias("loose_ends"),
        F.coalesce("_half", F.lit(0)).alias("half_branches"),
    )


CONNECTIVITY = ["parts", "euler_number", "outside", "graph_parts", "unplaced_voxels", "loose_ends"]


def connectivity(mask: DataFrame, skeleton: DataFrame, graph: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row per volume: the shape of its skeleton, and whether the strut graph drawn from it is whole.

    `graph` is the skeleton's nodes and branches where they are at hand.
    """
    graph = strut_graph(skeleton, *(graph or topology.skeleton_graph(skeleton))).withColumnRenamed("parts", "graph_parts")
    shape = topology.topology(skeleton).join(topology.outside(skeleton, mask), "volume_id")
    return shape.join(graph, "volume_id")


def nde_report(sections: Mapping[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """Inspection numbers of a lattice scan from any of the result tables: section -> (table, item column, metrics)."""
    return stack([tidy(frame, name, item, metrics) for name, (frame, item, metrics) in sections.items()])


def report_order(report: DataFrame, sections: list[str]) -> DataFrame:
    place: Column = F.array_position(F.array(*map(F.lit, sections)), F.col("section"))
    return report.orderBy(place, "item", "metric")
