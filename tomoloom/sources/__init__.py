"""File sources. `register(spark)` makes the binary formats available to `spark.read.format(...)`."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoloom.sources.npy import NpyVolume, PruningNpyVolume
from tomoloom.sources.stl import StlMesh
from tomoloom.sources.tiff import PruningTiffStack, TiffStack


def register(spark: SparkSession) -> None:
    """Make the formats known to the session.

    Only where it pushes filters into Python sources do comparisons of `z` prune files; call again when that setting
    changes. The options `z_from` and `z_to` prune in every session.
    """
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    volumes = (PruningNpyVolume, PruningTiffStack) if pushed else (NpyVolume, TiffStack)
    for source in (*volumes, StlMesh):
        spark.dataSource.register(source)


def explode_lines(lines: DataFrame) -> DataFrame:
    """Voxel rows `(volume_id, z, y, x, v)` of lines; filters on `z` still reach the source."""
    return lines.select("volume_id", "z", "y", F.posexplode("run").alias("x", "v"))


def read_voxels(spark: SparkSession, kind: str, path: str | None = None, **options) -> DataFrame:
    """Voxel rows of volume files; `kind` is `npy_volume` or `tiff_stack`."""
    return explode_lines(spark.read.format(kind).options(**options).load(path))
