"""Every catalog run at the smallest scale: the same rows as its SQL check, or at least rows."""

import duckdb
import pytest

import __spark_entry__ as contract
from tomoloom.plans import catalog, checks
from compare import connect, difference, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
UNCHECKED = {"heat_density", "skeleton_voxels", "skeleton_degree"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_only_named_runs_lack_sql():
    assert set(catalog.all_runs()) - set(checks.all_checks()) == UNCHECKED
    assert set(checks.all_checks()) <= set(catalog.all_runs())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", catalog.all_runs())
def test_run(spark, duck, name):
    ours = spark_rows(contract.queries()[name](spark, FOLDER))
    assert ours[1]
    if name not in UNCHECKED:
        assert difference(ours, duck_rows(duck, contract.oracle_sql()[name])) is None


@pytest.mark.parametrize("name", ["document_hits", "concepts_used", "concepts_used_first_page", "resolved_page_hits"])
def test_documents_without_letters(spark, tmp_path, name):
    texts = [(1, "12 34\n5.6 --"), (2, "12 34\n5.6"), (3, "the the anneal powder anneal"), (4, "the ment " * 9), (5, ""), (6, "-")]
    spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    ours = spark_rows(contract.queries()[name](spark, str(tmp_path)))
    assert difference(ours, duck_rows(con, contract.oracle_sql()[name])) is None
