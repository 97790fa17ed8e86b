"""Voxels as words: 64 neighbours along x are the bits of one number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64
WORD_KEY = ("volume_id", "z", "y", "xw")


def word_bit(x: str) -> Column:
    """The bit of a voxel in its word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col(x), F.lit(WORD)))


def to_words(voxels: DataFrame) -> DataFrame:
    """`(volume_id, z, y, xw, bits)` of a table of voxels; lines without any are absent."""
    return voxels.groupBy("volume_id", "z", "y", F.floor(F.col("x") / WORD).cast("int").alias("xw")).agg(
        F.bit_or(word_bit("x")).alias("bits")
    )


def to_voxels(words: DataFrame, bits: str = "bits") -> DataFrame:
    set_bits = F.filter(
        F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("getbit", F.col(bits), i) == 1
    )
    each = words.select("volume_id", "z", "y", "xw", F.explode(set_bits).alias("_bit"))
    return each.select("volume_id", "z", "y", (F.col("xw") * WORD + F.col("_bit")).alias("x"))
