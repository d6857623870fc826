"""Filters and projections that prepare sources."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import is_uint32, nan_inf_to_null
from ..functions.validity import is_finite
from ..sources.partitions import partition_filter

#: Id types whose ids are positive numbers (fixed values).
NUMERIC_UID_TYPES = ("OKID", "VKID")


def where_dt(df: DataFrame, dt: str) -> DataFrame:
    return df.where(F.col("dt") == dt)


def where_uid_types(df: DataFrame, uid_types: list[str] | None) -> DataFrame:
    return df.where(F.col("uid_type").isin(*uid_types)) if uid_types else df


def optional_where(df: DataFrame, condition: str | None) -> DataFrame:
    return df.where(condition) if condition else df


def imitate_uid(df: DataFrame, column: str | None, uid_type: str) -> DataFrame:
    """``column`` as ``uid`` with a constant type, in place of the present ids."""
    if not column:
        return df
    renamed = df.withColumnRenamed(column, "_uid").drop("uid", "uid_type")
    return renamed.withColumnRenamed("_uid", "uid").withColumn("uid_type", F.lit(uid_type))


def drop_invalid_uid(df: DataFrame) -> DataFrame:
    """Without rows of a NULL id, or a numeric type's id that is a number not above 0."""
    bad = F.col("uid_type").isin(*NUMERIC_UID_TYPES) & F.coalesce(F.col("uid").cast("string").try_cast("bigint") <= 0, F.lit(False))
    return df.where(F.col("uid").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def select_features(df: DataFrame, features: list[str] | None) -> DataFrame:
    """``uid, uid_type`` and the expressions; no list keeps all columns."""
    return drop_repeated_columns(df.selectExpr("uid", "uid_type", *features)) if features else df


def drop_repeated_columns(df: DataFrame) -> DataFrame:
    """Of columns with one name, whatever its case, only the first."""
    first: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        first.setdefault(c.lower(), i)
    indexed = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return indexed.select(*[F.col(f"_{i}").alias(df.columns[i]) for i in first.values()])


def drop_partition_columns(df: DataFrame, partitions: list[str]) -> DataFrame:
    return df.drop(*[c for c in partitions if c != "uid_type"])


def cast_column(df: DataFrame, column: str, dtype: str) -> DataFrame:
    """Cast a column found whatever its case."""
    found = next((c for c in df.columns if c.lower() == column.lower()), None)
    return df.withColumn(found, F.col(found).cast(dtype)) if found else df


def order_columns(df: DataFrame) -> DataFrame:
    """``uid``, data, then ``dt`` and ``uid_type`` if there."""
    tail = [c for c in ("dt", "uid_type") if c in df.columns]
    return df.select(*(["uid"] if "uid" in df.columns else []), *[c for c in df.columns if c not in ("uid", *tail)], *tail)


def select_csv(df: DataFrame, expressions: str, sep: str = ",") -> DataFrame:
    """A list of SQL expressions in one string; a separator within parentheses does not split."""
    parts, depth, current = [], 0, ""
    for ch in expressions:
        depth += (ch == "(") - (ch == ")")
        if ch == sep and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return df.selectExpr(*[p.strip() for p in [*parts, current] if p.strip()])


@dataclass
class SourceConfig:
    """How a source table becomes rows of a domain."""

    dt: str | None = None
    partitions: list[dict] = field(default_factory=list)
    where: str | None = None
    uid_column: str | None = None
    uid_imitation_type: str = ""
    uid_types: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)
    partition_columns: list[str] = field(default_factory=list)


def prepare_source(df: DataFrame, cfg: SourceConfig) -> DataFrame:
    """All preparation steps; partition filters come first so the scan is pruned."""
    if cfg.dt:
        df = where_dt(df, cfg.dt)
    if cfg.partitions:
        df = df.where(partition_filter(cfg.partitions))
    df = optional_where(df, cfg.where)
    df = imitate_uid(df, cfg.uid_column, cfg.uid_imitation_type)
    df = where_uid_types(df, cfg.uid_types)
    df = drop_invalid_uid(df)
    df = select_features(df, cfg.features)
    df = drop_partition_columns(df, cfg.partition_columns)
    return cast_column(df, "uid", "string")


def add_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    have = {c.lower() for c in df.columns}
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name.lower() not in have})


def _fractional(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def replace_nan_inf(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in every float or double scalar, array and map."""
    out = {}
    for f in df.schema:
        t = f.dataType
        if _fractional(t):
            out[f.name] = nan_inf_to_null(f.name, "scalar")
        elif isinstance(t, T.ArrayType) and _fractional(t.elementType):
            out[f.name] = nan_inf_to_null(f.name, "array")
        elif isinstance(t, T.MapType) and _fractional(t.valueType):
            out[f.name] = nan_inf_to_null(f.name, "map")
    return df.withColumns(out) if out else df


def validate_feature_type(t: T.DataType) -> None:
    """Strings, integers, fractions, arrays of those, maps of strings or integers to numbers."""
    single = (T.StringType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.FloatType, T.DoubleType)
    if isinstance(t, single):
        return
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, single):
        return
    if isinstance(t, T.MapType) and isinstance(t.keyType, (T.StringType, T.IntegerType, T.LongType)) and isinstance(t.valueType, T.NumericType):
        return
    raise ValueError(f"not a feature type: {t.simpleString()}")


def valid_feature(c: str, t: T.DataType, max_size: int) -> Column:
    """What a feature must be to be exported."""
    validate_feature_type(t)
    x = F.col(c)
    as_uint = lambda v: F.coalesce(is_uint32(v.cast("string")), F.lit(False))
    good = lambda v, vt: is_finite(v) if _fractional(vt) else as_uint(v)
    if isinstance(t, T.ArrayType):
        return F.coalesce(F.size(x).between(1, max_size) & F.forall(x, lambda v: good(v, t.elementType)), F.lit(False))
    if isinstance(t, T.MapType):
        keys, values = F.map_keys(x), F.map_values(x)
        return F.coalesce(F.size(x).between(1, max_size) & F.forall(keys, as_uint) & F.forall(values, is_finite), F.lit(False))
    return good(x, t)


def filter_features(df: DataFrame, columns: list[str], max_size: int = 1000) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [valid_feature(c, df.schema[c].dataType, max_size) for c in columns], F.lit(True)))


def valid_score_array(c: str) -> Column:
    """No NULL, NaN or negative score, and one above 0."""
    x = F.col(c)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (v < 0))
    return F.coalesce(~bad & F.exists(x, lambda v: v > 0), F.lit(False))


def temp_column_name(columns: list[str]) -> str:
    """A name that no column has."""
    return "u" * (max(map(len, columns), default=0) + 1)
