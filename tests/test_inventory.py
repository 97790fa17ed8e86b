from tomoloom.operators import inventory
from tomoloom.plans import reports

FILES = [
    ("scan/b.tif", "h1"),
    ("scan/a.TIF", "h1"),
    ("scan/c.tiff", "h2"),
    ("mesh/m.stl", "h1"),
    ("note", "h3"),
    (".hidden", "h4"),
    ("deep/er/x.npy", "h1"),
]


def table(spark):
    return inventory.describe_files(spark.createDataFrame(FILES, "path string, content_md5 string"))


def test_extensions_by_count_then_name(spark):
    found = [(r.ext, r.files) for r in inventory.extension_counts(table(spark)).collect()]
    assert found == [("(no ext)", 2), (".tif", 2), (".npy", 1), (".stl", 1), (".tiff", 1)]


def test_top_level_folders(spark):
    assert [r.folder for r in inventory.folders(table(spark)).collect()] == ["deep", "mesh", "scan"]


def test_duplicates_point_to_the_first_path(spark):
    for rows_per_task in (1, 1_000_000):
        volumes = inventory.volume_files(table(spark)).select("path", "content_md5")
        found = {r.path: (r.first_path, r.is_duplicate) for r in inventory.duplicates(volumes, rows_per_task).collect()}
        assert found == {
            "deep/er/x.npy": ("deep/er/x.npy", False),
            "scan/a.TIF": ("deep/er/x.npy", True),
            "scan/b.tif": ("deep/er/x.npy", True),
            "scan/c.tiff": ("scan/c.tiff", False),
        }


def test_report_sections_in_order(spark):
    report = reports.inventory_report(table(spark))
    ordered = reports.report_order(report, ["totals", "extensions", "folders", "volumes"])
    sections = list(dict.fromkeys(r.section for r in ordered.collect()))
    assert sections == ["totals", "extensions", "folders", "volumes"]
    values = {(r.section, r.item, r.metric): r.value for r in report.collect()}
    assert values["totals", "all", "files"] == 7 and values["volumes", "duplicate", "volumes"] == 2
