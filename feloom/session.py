"""Session settings that the operators rely on, and the loader of test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Merging maps keeps the last value of a repeated key.
SETTINGS = {"spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.session.timeZone": "UTC"}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
