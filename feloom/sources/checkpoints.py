"""Checkpoints and gates on row counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a plain local session without it gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/feloom-tables"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="feloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


class IntervalCheckpoint:
    """Every ``interval``-th frame is written as Parquet to a shared directory and read again.

    The files go when the driver ends.
    """

    def __init__(self, interval: int, directory: str):
        self.interval, self.directory, self.calls = interval, directory.rstrip("/"), 0

    def __call__(self, df: DataFrame, force: bool = False) -> DataFrame:
        self.calls += 1
        if not force and (self.interval <= 0 or self.calls % self.interval):
            return df
        path = f"{self.directory}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(place)
        return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_and_gate(df: DataFrame, path: str, min_rows: int, parts: int | None = None) -> DataFrame:
    """Write, read again and require a row count."""
    df.write.mode("overwrite").parquet(path)
    staged = df.sparkSession.read.parquet(path)
    rows = staged.count()
    if rows < min_rows:
        raise ValueError(f"{rows} rows, at least {min_rows} are needed")
    return staged.repartition(parts) if parts else staged


def check_rows(df: DataFrame, least: int, most: int) -> int:
    rows = df.count()
    if not least <= rows <= most:
        raise ValueError(f"{rows} rows are not within {least} and {most}")
    return rows


def check_unique(df: DataFrame, keys: list[str]) -> None:
    repeated = df.groupBy(*keys).count().where("count > 1").select(*keys).first()
    if repeated:
        raise ValueError(f"repeated key {repeated.asDict()}")


def persisted(df: DataFrame, policy: str = "") -> DataFrame:
    """``cache`` or nothing."""
    if policy not in ("", "cache"):
        raise ValueError(f"unknown cache policy {policy!r}")
    return df.persist() if policy else df


def dataset_stats(df: DataFrame, arrays: list[str]) -> dict:
    """Row count and sizes of array columns in one pass."""
    aggs = [F.count("*").alias("count")]
    for c in arrays:
        aggs += [F.min(F.size(c)).alias(f"min_{c}"), F.max(F.size(c)).alias(f"max_{c}")]
    return df.agg(*aggs).first().asDict()
