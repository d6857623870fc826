"""Partitions of tables: filters, discovery and success marks."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def partition_filter(partitions: list[dict], dt: str = "dt") -> Column:
    """OR over the dicts of AND over ``column = value``; each term begins with a present ``dt``."""
    present = F.col(dt).isNotNull()
    if not partitions:
        return present
    terms = [reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in p.items()], present) for p in partitions]
    return reduce(lambda a, b: a | b, terms)


def select_partitions(df: DataFrame, columns: list[str], partitions: list[dict]) -> DataFrame:
    """A projection of some partitions; both reach the scan."""
    return df.where(partition_filter(partitions)).select(*columns)


def table_partitions(spark: SparkSession, table: str) -> DataFrame:
    """One row per partition, one string column per partition column."""
    shown = spark.sql(f"SHOW PARTITIONS {table}")
    first = shown.first()
    names = [p.split("=")[0] for p in first[0].split("/")] if first else []
    return shown.select(*[F.regexp_extract("partition", rf"(?:^|/){n}=([^/]*)", 1).alias(n) for n in names])


def _wanted(conf: dict) -> list[dict]:
    lists = {k: v if isinstance(v, (list, tuple)) else [v] for k, v in conf.items()}
    return [dict(zip(lists, values)) for values in product(*lists.values())]


def find_partitions(partitions: DataFrame, conf: dict, min_dt: str | None = None, max_dt: str | None = None, match: str = "all", mode: str = "max") -> list[dict]:
    """Partitions of the configured products, at the latest ``dt`` (``max``) or at each (``list``).

    ``conf`` maps partition columns to a value or a list. A ``dt`` in it fixes the
    candidates, else they are all within [``min_dt``, ``max_dt``]. A ``dt`` counts
    if ``all`` or ``any`` of the product exist there. The answer has one row per
    found partition, which is what a table can hold.
    """
    fixed = conf.get("dt")
    wanted = _wanted({k: v for k, v in conf.items() if k != "dt"})
    df = partitions
    if fixed is not None:
        df = df.where(F.col("dt").isin(*(fixed if isinstance(fixed, (list, tuple)) else [fixed])))
    if min_dt:
        df = df.where(F.col("dt") >= min_dt)
    if max_dt:
        df = df.where(F.col("dt") <= max_dt)
    if wanted != [{}]:
        df = df.where(partition_filter(wanted))
    names = ["dt", *[k for k in conf if k != "dt"]]
    distinct = df.select(*names).distinct()
    need = len(wanted) if match == "all" else 1
    good = distinct.groupBy("dt").count().where(F.col("count") >= need).select("dt")
    if mode == "max":
        good = good.agg(F.max("dt").alias("dt")).where("dt is not null")
    return [r.asDict() for r in distinct.join(good, "dt", "left_semi").orderBy(*names).collect()]


#: Names of partition parameters that may not be used as a mark (fixed values).
RESERVED_MARKS = frozenset("transient_lastDdlTime numFiles totalSize numRows rawDataSize COLUMN_STATS_ACCURATE EXTERNAL".split())
MARK_FILE = "_FELOOM_"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def set_mark(spark: SparkSession, partition_path: str, name: str, on: bool = True) -> None:
    """Set or remove a success mark of a partition: an empty file that scans ignore."""
    if name in RESERVED_MARKS:
        raise ValueError(f"{name} is reserved")
    fs, path = _fs(spark, f"{partition_path.rstrip('/')}/{MARK_FILE}{name}")
    if on:
        fs.create(path, True).close()
    else:
        fs.delete(path, False)


def has_mark(spark: SparkSession, partition_path: str, name: str) -> bool:
    fs, path = _fs(spark, f"{partition_path.rstrip('/')}/{MARK_FILE}{name}")
    return fs.exists(path)
