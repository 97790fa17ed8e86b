"""Mesh files written by many tasks: every byte as if one task had sorted the whole mesh."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomoloom.plans import catalog, stored
from tomoloom.sources.stl import HEADER_BYTES, RECORD, header_count


def save_orders(spark, folder, n):
    keys = F.expr("(id * 7919) % 100003").alias("o_orderkey")
    status = F.expr("case when id = 5 then 'P' when id % 10 = 0 then 'F' else 'O' end").alias("o_orderstatus")
    spark.range(n).select(keys, (F.col("id") % 1009).alias("o_custkey"), status).repartition(3).write.parquet(f"{folder}/orders.parquet")


@pytest.mark.parametrize("in_place", [True, False])
def test_no_task_holds_a_mesh(spark, tmp_path, monkeypatch, in_place):
    def grouped(*_):
        raise AssertionError("a whole mesh goes to one group")

    monkeypatch.setattr(stored, "_grouped", grouped)
    monkeypatch.setattr(stored, "_in_place", lambda place: in_place, raising=False)
    save_orders(spark, tmp_path, 4000)
    rows = sorted(spark.read.parquet(f"{tmp_path}/orders.parquet").collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        place = stored.mesh_files(spark, str(tmp_path)).removeprefix("file:")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name in "OFP":
        expected = []
        for k, c, status in rows:
            if status == name:
                expected.append((k % 97, k % 89, k % 50, c % 83, c % 79, c % 50, (k + c) % 73, (k + c) % 71, (k + c) % 50))
        path = f"{place}/mesh_{name}.stl"
        with open(path, "rb") as file:
            found = np.frombuffer(file.read()[HEADER_BYTES:], RECORD)
        assert header_count(path) == len(expected) == found.size
        assert (found["corners"] == np.array(expected)).all()


def test_names_are_not_cut_from_every_triangle(spark):
    """The planner copies a cut that a join needs down to the triangles, where it takes longer than reading them."""
    text = catalog.all_runs()["file_meshes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "stl_mesh" not in text
