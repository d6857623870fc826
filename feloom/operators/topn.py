"""Top rows and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import IntervalCheckpoint, shared_folder


def _order(columns: list[str], ascending: bool) -> list[Column]:
    return [F.col(c).asc() if ascending else F.col(c).desc() for c in columns]


def top_rows(df: DataFrame, n: int, columns: list[str], ascending: bool = False) -> DataFrame:
    """The first ``n`` rows of the order (each task keeps its best ``n``, then they are merged)."""
    return df.orderBy(*_order(columns, ascending)).limit(n)


def global_rank(df: DataFrame, columns: list[str], ascending: bool = False, rank: str = "rank", directory: str | None = None) -> DataFrame:
    """Ranks from 1 over all rows without sorting them in one task.

    Rows are dealt to tasks by ranges of the order, and written with the number of
    their task to ``directory`` (by default the session's shared folder): ranges come from a sample, so rows
    and counts must not be dealt twice. A rank is the row number in the task plus
    the rows of the tasks before. The table of row counts per task is a row per task.
    """
    order = _order(columns, ascending)
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = IntervalCheckpoint(1, directory or shared_folder(df.sparkSession))(dealt)
    counts = dealt.groupBy("_part").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    numbered = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(before), "_part").withColumn(rank, F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def top_rows_ranked(df: DataFrame, n: int, columns: list[str], ascending: bool = False) -> DataFrame:
    """As :func:`top_rows`, by global ranks; for an ``n`` too large for one task."""
    return global_rank(df, columns, ascending, "_rank").where(F.col("_rank") <= n).drop("_rank")


def local_rank(df: DataFrame, columns: list[str], ascending: bool = False, rank: str = "local_rank") -> DataFrame:
    """Row numbers within each present partition, without a shuffle key of their own."""
    window = Window.partitionBy("_part").orderBy(*_order(columns, ascending))
    return df.withColumn("_part", F.spark_partition_id()).withColumn(rank, F.row_number().over(window)).drop("_part")


def top_rows_approx(df: DataFrame, n: int, columns: list[str], partitions: int, key: str | None = None, ascending: bool = False) -> DataFrame:
    """``floor(n / partitions)`` rows of each of ``partitions`` parts; which rows depends on the dealing."""
    dealt = df.repartition(partitions, key) if key else df.repartition(partitions)
    return local_rank(dealt, columns, ascending, "_rank").where(F.col("_rank") <= n // partitions).drop("_rank")


def cumulative_sum(c: str, order: list[str], by: list[str]) -> Column:
    return F.sum(c).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def dealt_and_sorted(df: DataFrame, partitions: int, key: str) -> DataFrame:
    return df.repartition(partitions, key).sortWithinPartitions(key)
