"""Placement of row and group work that costs far more than its input bytes suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Input of one costly task.
BYTES_PER_TASK = 4 << 20
UNKNOWN_BYTES = 1 << 60


def _input_bytes(df: DataFrame) -> int | None:
    """Size of the tables a plan reads, which for a scan comes from the file listing; None where one is unknown.

    Sizes further up the plan are products of guesses and grow without bound over joins and generators.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(size >= UNKNOWN_BYTES for size in sizes) else sum(sizes)


def spread_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows by the keys of a following grouped function into as many tasks as their size asks for.

    Runtime coalescing sizes tasks by input bytes and would merge groups whose work far exceeds their input. The number
    of tasks grows with the input and is two per core at least.
    """
    spark = df.sparkSession
    size = _input_bytes(df)
    asked = int(spark.conf.get("spark.sql.shuffle.partitions")) if size is None else -(-size // BYTES_PER_TASK)
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, asked), *keys)


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """Hash a table's rows by the key into a task per core at least, and more as the table grows, before costly row work.

    A row of text turns into thousands of rows later; a task that reads a whole split of texts would hold them all. What
    is grouped or joined by the key afterwards stays in these tasks: the planner deals out anew what has fewer tasks than
    `spark.sql.shuffle.partitions`.
    """
    spark = df.sparkSession
    size = _input_bytes(df)
    if size is None:
        return df
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(least, -(-size // BYTES_PER_TASK)), key)


def spread_sorted(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows in ranges of the keys, and sort each, into as many tasks as their size asks for, two per core at least.

    One key with most of the rows is cut into many ranges by the keys behind it.
    """
    spark = df.sparkSession
    size = _input_bytes(df)
    asked = int(spark.conf.get("spark.sql.shuffle.partitions")) if size is None else -(-size // BYTES_PER_TASK)
    return df.repartitionByRange(max(2 * spark.sparkContext.defaultParallelism, asked), *keys).sortWithinPartitions(*keys)
