"""Writers: DDL, static and bucketed partition inserts, exports, directory moves."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashes import row_hash
from .partitions import _fs


def create_table_ddl(table: str, schema: T.StructType, partitions: list[str], fmt: str = "ORC") -> str:
    """``CREATE TABLE IF NOT EXISTS``; needs a qualified name and a column that is no partition."""
    database, _, name = table.partition(".")
    data = [f for f in schema if f.name not in partitions]
    if not database or not name or not data:
        raise ValueError("a table needs a database, a name and a column that is no partition")
    parts = [f for p in partitions for f in schema if f.name == p]
    body = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*data, *parts])
    by = f" PARTITIONED BY ({', '.join(f'`{p.name}`' for p in parts)})" if parts else ""
    return f"CREATE TABLE IF NOT EXISTS {table} ({body}) USING {fmt}{by}"


def insert_static_partition(df: DataFrame, table: str, partition: dict[str, str]) -> None:
    """Overwrite one partition with the columns that are no partition columns."""
    spark = df.sparkSession
    target = spark.read.table(table).schema
    columns = [f.name for f in target if f.name not in partition]
    view = f"_insert_{abs(hash((table, tuple(partition.items())))):x}"
    df.select(*columns).createOrReplaceTempView(view)
    spec = ", ".join("`{}`='{}'".format(k, str(v).replace("'", "\\'")) for k, v in partition.items())
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({spec}) SELECT * FROM {view}")
    spark.catalog.dropTempView(view)


def bucket_stats(df: DataFrame, partitions: list[str], max_rows: int) -> DataFrame:
    """Rows, buckets and first bucket of each partition; a NULL partition value is an error when it is read."""
    counts = df.groupBy(*partitions).agg(F.count("*").alias("rows"))
    for p in partitions:
        counts = counts.withColumn(p, F.coalesce(p, F.raise_error(F.lit(f"NULL in partition column {p}")).cast(df.schema[p].dataType)))
    counts = counts.withColumn("buckets", F.ceil(F.col("rows") / max_rows).cast("long"))
    order = Window.orderBy(*partitions).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first_bucket", F.coalesce(F.sum("buckets").over(order), F.lit(0)))


def bucketed(df: DataFrame, partitions: list[str], max_rows: int) -> DataFrame:
    """Rows dealt so that a file of a partition has about ``max_rows`` rows.

    The number of partitions may be large, so their statistics are joined; the
    bucket of a row follows from a hash of the row, so a repeated task agrees.
    """
    stats = bucket_stats(df, partitions, max_rows).select(*partitions, "buckets", "first_bucket")
    total = stats.agg(F.sum("buckets")).first()[0] or 1
    placed = df.join(stats, partitions).withColumn("_bucket", F.col("first_bucket") + F.pmod(row_hash(df, df.columns), F.col("buckets")))
    return placed.repartitionByRange(int(2 * total), "_bucket").select(*df.columns)


def insert_bucketed(df: DataFrame, path: str, partitions: list[str], max_rows: int, schema: T.StructType | None = None, overwrite: bool = True, raise_on_missing: bool = False, fmt: str = "parquet") -> None:
    """Write partition directories; present partitions that get rows are replaced (or added to)."""
    if schema is not None:
        missing = [f.name for f in schema if f.name not in df.columns]
        if missing and raise_on_missing:
            raise ValueError(f"missing columns: {missing}")
        df = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name in missing}).select(*[F.col(f.name).cast(f.dataType) for f in schema])
    writer = bucketed(df, partitions, max_rows).write.partitionBy(*partitions).format(fmt)
    if overwrite:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)
    else:
        writer.mode("append").save(path)


def repartition_rows(df: DataFrame, max_rows: int) -> DataFrame:
    """A flat table in ``ceil(rows / max_rows)`` parts."""
    return df.repartition(max(1, -(-df.count() // max_rows)))


def shrink(df: DataFrame, parts: int, key: str = "uid") -> DataFrame:
    """Fewer parts by key; never more than there are."""
    return df.repartition(parts, key) if df.rdd.getNumPartitions() > parts else df


def write_parquet(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def feature_text(df: DataFrame, column: str, item_sep: str = ",", kv_sep: str = ":") -> Column:
    """A feature as one string: items, or ``key:value`` entries in key order."""
    t = df.schema[column].dataType
    c = F.col(column)
    if isinstance(t, T.MapType):
        entries = F.array_sort(F.map_entries(c))
        return F.array_join(F.transform(entries, lambda e: F.concat_ws(kv_sep, e["key"].cast("string"), e["value"].cast("string"))), item_sep)
    if isinstance(t, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: x.cast("string")), item_sep)
    return c.cast("string")


def export_frame(df: DataFrame, user: str, features: list[str], prefixes: bool = True) -> DataFrame:
    """``user`` and one string per feature, named ``num:f`` or ``cat:f`` by type."""
    def name(f: str) -> str:
        t = df.schema[f].dataType
        inner = t.elementType if isinstance(t, T.ArrayType) else t
        kind = "cat" if isinstance(inner, (T.StringType, T.IntegerType, T.LongType)) else "num"
        return f"{kind}:{f}" if prefixes else f

    return df.select(F.col(user).alias("user"), *[feature_text(df, f).alias(name(f)) for f in features])


def write_csv(df: DataFrame, path: str, sep: str = ";", header: bool = True, quote: str = "", max_rows: int | None = None) -> None:
    writer = df.write.mode("overwrite").option("sep", sep).option("header", header).option("quote", quote or "\u0000").option("emptyValue", "")
    (writer.option("maxRecordsPerFile", max_rows) if max_rows else writer).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    write_csv(df, path, sep="\t", header=False)


def swap_directory(spark: SparkSession, new: str, target: str) -> None:
    """Put a finished directory in place of the target."""
    fs, source = _fs(spark, new)
    goal = spark._jvm.org.apache.hadoop.fs.Path(target)
    if fs.exists(goal):
        fs.delete(goal, True)
    fs.mkdirs(goal.getParent())
    if not fs.rename(source, goal):
        raise OSError(f"can't move {new} to {target}")


def move_files(spark: SparkSession, pairs: list[tuple[str, str]], threads: int = 16) -> list[str]:
    """Move many files at once; returns what failed. File system calls run on the driver, in threads."""
    def move(pair: tuple[str, str]) -> str | None:
        try:
            fs, source = _fs(spark, pair[0])
            goal = spark._jvm.org.apache.hadoop.fs.Path(pair[1])
            fs.mkdirs(goal.getParent())
            return None if fs.rename(source, goal) else f"{pair[0]}: not moved"
        except Exception as e:  # reported, not raised: the other moves go on
            return f"{pair[0]}: {e}"

    with ThreadPoolExecutor(threads) as pool:
        return [e for e in pool.map(move, pairs) if e]
