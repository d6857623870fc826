"""Readers: tables, directories of files with different columns, text files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .partitions import _fs


def load_table(spark: SparkSession, name: str) -> DataFrame | None:
    """A catalog table, or None if there is none."""
    return spark.read.table(name) if spark.catalog.tableExists(name) else None


def load_tables(spark: SparkSession, names: list[str]) -> dict[str, DataFrame]:
    found = {n: load_table(spark, n) for n in names}
    missing = [n for n, df in found.items() if df is None]
    if missing:
        raise ValueError(f"no such tables: {missing}")
    return found


def partition_directories(spark: SparkSession, root: str) -> list[tuple[dict[str, str], str]]:
    """Partition values and path of each directory ``k=v/...`` below ``root`` that has files."""
    fs, start = _fs(spark, root)
    found, todo = [], [(start, {})]
    while todo:
        path, values = todo.pop()
        leaf = False
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if status.isDirectory() and "=" in name:
                key, value = name.split("=", 1)
                todo.append((status.getPath(), values | {key: spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(value)}))
            elif status.isFile() and not name.startswith(("_", ".")):
                leaf = True
        if leaf:
            found.append((values, path.toString()))
    return sorted(found, key=lambda x: x[1])


def read_union(spark: SparkSession, root: str, schema: T.StructType, condition=lambda values: True, fmt: str = "orc") -> DataFrame:
    """Partition directories that satisfy ``condition``, each read with its own files' schema.

    Columns are matched to ``schema`` by position, cast and renamed, missing ones
    are NULL, partition values are added again. Directories whose files have one
    schema are read by one scan. No directory is an error.
    """
    chosen = [(v, p) for v, p in partition_directories(spark, root) if condition(v)]
    if not chosen:
        raise ValueError(f"no partition of {root} satisfies the condition")
    parts = list(chosen[0][0])
    data = [f for f in schema if f.name not in parts]
    groups: dict[str, list[str]] = {}
    schemas = {}
    for values, path in chosen:
        own = spark.read.format(fmt).load(path).schema
        groups.setdefault(own.json(), []).append(path)
        schemas[own.json()] = own
    frames = []
    for key, paths in groups.items():
        df = spark.read.format(fmt).schema(schemas[key]).option("basePath", root).load(paths)
        cols = schemas[key].names
        picked = [(F.col(f"`{cols[i]}`") if i < len(cols) else F.lit(None)).cast(f.dataType).alias(f.name) for i, f in enumerate(data)]
        frames.append(df.select(*picked, *[F.col(p).cast("string").alias(p) for p in parts]))
    return reduce(DataFrame.unionByName, frames)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file (a model, a config) as one string."""
    rows = spark.read.text(path, wholetext=True).collect()
    return "".join(r[0] for r in rows)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([]))
