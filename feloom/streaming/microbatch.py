"""Batch plans over a stream: each micro-batch runs a plan and replaces the partitions it touches.

The feature operators are batch operators; a stream feeds them one micro-batch at
a time. Writing with dynamic partition overwrite makes a repeated batch harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def run_plan(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, partitions: list[str], checkpoint: str, available_now: bool = True):
    """Start a query that applies ``plan`` to each micro-batch and writes partition directories."""

    def write(batch: DataFrame, batch_id: int) -> None:
        plan(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
