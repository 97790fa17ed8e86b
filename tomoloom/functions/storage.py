"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one only for an unset, single-machine session."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if app not in _local_folder:
        _local_folder[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        # The folder is this process's own; its tables end with it.
        atexit.register(shutil.rmtree, _local_folder[app], ignore_errors=True)
    return _local_folder[app]


def shared_path(spark: SparkSession, name: str = "") -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/tomoloom-{uuid.uuid4().hex}{name}"


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once and read it back.

    Cuts lineage without tying data to one executor, and gives the optimizer the true size, so a following join
    broadcasts this side only when it is below `spark.sql.autoBroadcastJoinThreshold`.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by `materialize` once a newer table has replaced it."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("tomoloom-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
