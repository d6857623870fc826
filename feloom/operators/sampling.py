"""Samples per group and fast samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import row_hash


def group_key(columns: list[str]) -> Column:
    """One string per combination of values; NULL is ``-``."""
    return F.concat_ws("/", F.lit("g"), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])


def stratified_sample(df: DataFrame, columns: list[str], size: int, seed: int = 0, key: list[str] | None = None) -> DataFrame:
    """About ``size`` rows of each group, all of a smaller one: a row stays with probability size over count.

    The count per group is joined, so the number of groups is not bounded. With ``key``,
    the columns that tell rows apart, the draw is a hash of them: the same in each run
    and in each repeated task. Without it the draw is random.
    """
    keyed = df.withColumn("_group", group_key(columns))
    counts = keyed.groupBy("_group").count().select("_group", F.least(F.lit(1.0), F.lit(float(size)) / F.col("count")).alias("_share"))
    draw = F.pmod(F.xxhash64(row_hash(df, key), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) if key else F.rand(seed)
    return keyed.join(counts, "_group").where(draw < F.col("_share")).drop("_group", "_share")


def sample_fast(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows; Spark reads only as many partitions as it takes."""
    return df.limit(n)
