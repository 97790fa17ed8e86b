"""Joins and ordered totals whose tasks stay bounded when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomoloom.functions.storage import materialize

ROWS_PER_TASK = 1_000_000


def hot_keys(
    counts: DataFrame, keys: Sequence[str], rows: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Every key with more than `rows_per_task` rows and the number of parts it should be split into.

    Written once, so that its true size decides how it is joined: there are at most (all rows) / `rows_per_task`.
    """
    return materialize(
        counts.filter(F.col(rows) > rows_per_task).select(
            *keys, F.ceil(F.col(rows) / F.lit(rows_per_task)).cast("int").alias("_parts")
        )
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    hot: DataFrame,
    spread: Sequence[str],
    hot_on: Sequence[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Equi-join where the rows of a hot key on the left are spread over several tasks.

    Each hot left row picks one part by hashing `spread`; the right rows of that key are repeated once per part.
    Only right-side rows of hot keys are repeated, so `how` must be inner or left.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot do a {how} join")
    hot_on = list(hot_on or keys)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    left = (
        left.join(hot, hot_on, "left")
        .withColumn("_part", F.pmod(F.xxhash64(*spread), parts).cast("int"))
        .drop("_parts")
    )
    right = (
        right.join(hot, hot_on, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    return left.join(right, [*keys, "_part"], how).drop("_part")


def bucketed_totals(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[tuple[str, bool]],
    order: Sequence[Column],
    totals: Mapping[str, Column],
) -> DataFrame:
    """Running totals within `group`, exact, without one task holding a whole group.

    `bucket` lists (column, descending) pairs that agree with `order`: every row of a bucket comes before every row
    of the next one. Totals per bucket are accumulated over the (few) buckets, then inside each bucket separately.
    For each entry `name: value` of `totals` the result gains `name` (total up to and including the row) and
    `name_all` (total of the group).
    """
    keys = [*group, *(name for name, _ in bucket)]
    bucket_order = [F.desc(name) if desc else F.asc(name) for name, desc in bucket]
    across = Window.partitionBy(*group)
    before = across.orderBy(*bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    inside = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sizes = df.groupBy(*keys).agg(*(F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()))
    offsets = sizes.select(
        *keys,
        *(
            F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}")
            for name in totals
        ),
        *(F.sum(f"_sum_{name}").over(across).alias(f"{name}_all") for name in totals),
    )
    out = df.join(offsets, keys)
    for name, value in totals.items():
        out = out.withColumn(name, F.sum(value).over(inside) + F.col(f"_before_{name}"))
    return out.drop(*(f"_before_{name}" for name in totals))


def bucketed_row_number(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[tuple[str, bool]],
    order: Sequence[Column],
    name: str,
) -> DataFrame:
    """`row_number` over `group` with bounded tasks; see `bucketed_totals` for the meaning of `bucket`."""
    ranked = bucketed_totals(df, group, bucket, order, {name: F.lit(1).cast("bigint")})
    return ranked.drop(f"{name}_all")
