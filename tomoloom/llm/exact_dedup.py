"""Exact dedup by tree-merging digest runs, in DataFrame operations only.

Every input partition is one run of (digest, largest id). Runs are merged `fan_in` at a time in rounds until one is left:
a round groups the rows of the runs that meet by their whole digest, so it is spread by digest however few runs remain,
and a digest that holds a third of all rows enters a round once per run at most. A digest is SHA-256 together with an
independent 64-bit hash and the byte length; all three must agree at every level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoloom.functions.storage import materialize
from tomoloom.llm.common import texts, unused, with_key

DIGEST = ["text_sha256", "check", "n_bytes"]
FAN_IN = 8


def _numbered(docs: DataFrame) -> DataFrame:
    body = F.col("text").cast("binary")
    return texts(docs).select(
        "doc_id",
        F.sha2(body, 256).alias("text_sha256"),
        F.xxhash64(body).alias("check"),
        F.octet_length(body).alias("n_bytes"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )


def _merge(runs: DataFrame, fan_in: int) -> DataFrame:
    return runs.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), *DIGEST).agg(
        F.max("best").alias("best"), F.sum("size").alias("size")
    )


def exact_groups(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; a null id is smaller than any other. Rows that repeat both id
    and text are told apart by their place, so one of them stays. Null texts equal empty ones. An empty table gives no
    rows; other columns are ignored.
    """
    rows = materialize(_numbered(docs))
    first = rows.groupBy("run", *DIGEST).agg(
        F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("size")
    )
    runs = materialize(first)
    merged = runs
    left = (runs.agg(F.max("run")).first()[0] or 0) + 1
    while left > 1:
        merged = _merge(merged, fan_in)
        left = -(-left // fan_in)
    # Back down: a digest meets its group once per run, and each run's rows meet it there.
    down = runs.select("run", *DIGEST).join(merged.select(*DIGEST, "best", "size"), DIGEST)
    return rows.join(down, ["run", *DIGEST]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """`docs` without the copies: of rows with equal text, the one with the largest doc_id, all columns kept.

    Null texts equal empty ones, a null id is smaller than any other, and of rows that repeat id and text one stays. Rows
    are named by their id where it names one row, and the table is written again only where it does not.
    """
    key = unused(docs, "_dedup_row")
    numbered = with_key(docs, key)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    first = materialize(
        numbered.select(
            F.spark_partition_id().alias("run"),
            F.sha2(body, 256).alias("text_sha256"),
            F.xxhash64(body).alias("check"),
            F.octet_length(body).alias("n_bytes"),
            F.struct("doc_id", F.col(key).alias("row")).alias("one"),
        )
        .groupBy("run", "text_sha256", "check", "n_bytes")
        .agg(F.max("one").alias("best"), F.count(F.lit(1)).alias("size"))
    )
    merged, left = first, (first.agg(F.max("run")).first()[0] or 0) + 1
    while left > 1:
        merged = _merge(merged, fan_in)
        left = -(-left // fan_in)
    return numbered.join(merged.select(F.col("best.row").alias(key)), key, "left_semi").drop(key)
