"""Batch scoring and table migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..ml.apply import apply_models
from ..operators.joins import activity_filter
from ..sources.writers import create_table_ddl, write_parquet


def score_active(features: DataFrame, active: DataFrame | None, models: list, keep: list[str], group_column: str | None = None, how: str = "inner") -> DataFrame:
    """Models over the feature rows of active users."""
    rows = activity_filter(features, active, ["uid"], how) if active is not None else features
    return apply_models(rows, models, keep, group_column)


def apply_files(spark: SparkSession, source: str, target: str, models: list, keep: list[str]) -> None:
    """Parquet in, compressed Parquet out."""
    write_parquet(apply_models(spark.read.parquet(source), models, keep), target)


def migration_script(spark: SparkSession, table: str, partitions: list[str], columns: dict[str, str]) -> list[str]:
    """Statements that rebuild a table with other column expressions under its name; the old one stays aside."""
    old = spark.read.table(table)
    made = old.selectExpr(*[f"{e} as {n}" for n, e in columns.items()])
    fresh, kept = f"{table}_new", f"{table}_old"
    return [
        create_table_ddl(fresh, made.schema, partitions, "PARQUET"),
        f"INSERT INTO {fresh} SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table}",
        f"ALTER TABLE {table} RENAME TO {kept}",
        f"ALTER TABLE {fresh} RENAME TO {table}",
    ]
