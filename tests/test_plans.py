"""What the physical plans must and must not contain."""

import numpy as np
import pytest

from tomoloom.operators import concepts, lattice, mesh, volume
from tomoloom.plans import catalog, derived
from tomoloom.plans.jobs import store_voxels

from arrays import voxel_rows

FOLDER = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", catalog.all_runs())
def test_no_run_pairs_all_rows(spark, name):
    text = plan(catalog.all_runs()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(catalog.all_runs()["file_folders"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in text
    assert "text" not in text.split("ReadSchema")[-1]


def test_slices_and_slabs_are_pruned_at_the_scan(spark, tmp_path):
    store_voxels(voxel_rows(spark, np.zeros((70, 3, 3))), str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    text = plan(volume.take_slice(stored.filter("z_slab = 1"), 40))
    assert "EqualTo(z,40)" in text and "z_slab" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_prompt_matching_moves_no_words(spark):
    words = spark.createDataFrame([], "doc_id bigint, page_no int, word_no int, word string")
    text = plan(concepts.prompt_hits(words, derived.CONCEPTS))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_segmentation_and_cross_sections_do_not_shuffle(spark):
    for frame in (
        volume.segment(derived.volume(spark, FOLDER), 0.5),
        mesh.cross_section(derived.triangles(spark, FOLDER), 1.0),
        lattice.json_profile(lattice.parse_graphs(derived.graph_documents(spark, FOLDER))),
    ):
        assert "Exchange" not in plan(frame)


def test_top_terms_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(concepts.auto_concepts(derived.word_boxes(spark, FOLDER)))
    assert "TakeOrderedAndProject" in plan(catalog.all_runs()["top_pages"](spark, FOLDER))


def test_one_pass_over_the_voxels_for_a_whole_sweep(spark):
    text = plan(volume.threshold_sweep(derived.volume(spark, FOLDER), [0.1, 0.2, 0.3]))
    assert text.count("Scan parquet") == 1
