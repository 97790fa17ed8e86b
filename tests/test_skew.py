from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomoloom.functions.skew import bucketed_row_number, bucketed_totals, hot_keys, salted_join


def rows_with_a_hot_key(spark, n=3000):
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 40).alias("k")
    )


def test_salted_join_equals_join_for_every_kind(spark):
    left = rows_with_a_hot_key(spark)
    right = spark.range(-1, 30).select(F.col("id").alias("k"), (F.col("id") * 7).alias("w"))
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, ["k"], "n", rows_per_task=100)
    assert [(r.k, r["_parts"]) for r in hot.collect()] == [(-1, 10)]
    for how in ("inner", "left", "left_semi", "left_anti"):
        expected = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
        found = salted_join(left, right, ["k"], hot, ["id"], how=how)
        assert sorted(map(tuple, found.collect()), key=str) == expected


def test_every_hot_key_is_split(spark):
    counts = spark.range(1500).select(F.col("id").alias("k"), F.lit(10).alias("n"))
    assert hot_keys(counts, ["k"], "n", rows_per_task=4).filter("_parts = 3").count() == 1500


def test_hot_rows_land_in_several_parts(spark):
    left = rows_with_a_hot_key(spark)
    hot = spark.createDataFrame([(-1, 10)], "k bigint, _parts int")
    right = spark.createDataFrame([(-1, 0)], "k bigint, w int")
    plan = salted_join(left, right.hint("merge"), ["k"], hot, ["id"])
    assert plan.count() == 1000
    spread = left.filter("k = -1").select(F.pmod(F.xxhash64("id"), F.lit(10)).alias("p")).distinct().count()
    assert spread == 10


def test_bucketed_totals_equal_plain_windows(spark):
    rows = spark.range(2000).select(
        (F.col("id") % 3).alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(50)).alias("score"),
        F.col("id").alias("page"),
    )
    bucketed = rows.withColumn("b", F.floor(F.col("page") / 100))
    order = [F.desc("score"), F.asc("page")]
    plain = Window.partitionBy("g").orderBy(*order)
    expected = rows.select(
        "g",
        "page",
        F.row_number().over(plain).cast("bigint").alias("rank"),
    )
    found = bucketed_row_number(bucketed, ["g"], [("score", True), ("b", False)], [F.asc("page")], "rank")
    assert sorted(map(tuple, found.select("g", "page", "rank").collect())) == sorted(map(tuple, expected.collect()))
    totals = bucketed_totals(
        bucketed, ["g"], [("score", True), ("b", False)], [F.asc("page")], {"t": F.col("score")}
    )
    running = rows.select(
        "g",
        "page",
        F.sum("score").over(plain.rowsBetween(Window.unboundedPreceding, 0)).alias("t"),
        F.sum("score").over(Window.partitionBy("g")).alias("t_all"),
    )
    assert sorted(map(tuple, totals.select("g", "page", "t", "t_all").collect())) == sorted(map(tuple, running.collect()))
