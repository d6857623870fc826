"""Aggregates that ignore invalid values, for scalars, arrays (by place) and maps (by key).

Two forms. The composable one is a Column for any ``agg``; it holds a group's
collections in memory. The relational one (:func:`aggregate_elements`) explodes
and aggregates per element, so it combines on the map side and spills.

Everything is computed in double and cast back: integers truncate, decimals
gain ten digits as scalars. Without a valid value the result is NULL. Arrays:
the result is as long as the longest, only NULL arrays give NULL, empty ones an
empty array. Maps: all keys that occur, a key without valid value has NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .validity import col, is_finite, valid

_SCALAR = {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg}


def _reduce(values: Column, fn: str) -> Column:
    """Of an array of doubles that may be empty."""
    if fn == "min":
        return F.array_min(values)
    if fn == "max":
        return F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    total = F.when(F.size(values) > 0, total)
    return total if fn == "sum" else total / F.size(values)


def scalar_type(t: T.DataType) -> T.DataType:
    if isinstance(t, T.DecimalType):
        return T.DecimalType(min(38, t.precision + 10), t.scale)
    return t


def generic(fn: str, c, dtype: T.DataType | str) -> Column:
    """``min``, ``max``, ``sum`` or ``avg`` of a column of the given type."""
    dtype = T.DataType.fromDDL(dtype) if isinstance(dtype, str) else dtype
    c = col(c)
    if isinstance(dtype, T.ArrayType):
        lists = F.collect_list(c)
        size = F.array_max(F.transform(lists, F.size))
        at = lambda i: _reduce(F.filter(F.transform(lists, lambda a: valid(F.get(a, i))), lambda x: x.isNotNull()), fn).cast(dtype.elementType)
        return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), at)).when(size == 0, F.array().cast(dtype))
    if isinstance(dtype, T.MapType):
        maps = F.collect_list(c)
        keys = F.array_sort(F.array_distinct(F.flatten(F.transform(maps, F.map_keys))))
        of = lambda k: _reduce(F.filter(F.transform(maps, lambda m: valid(F.try_element_at(m, k))), lambda x: x.isNotNull()), fn).cast(dtype.valueType)
        return F.when(F.size(maps) > 0, F.map_from_arrays(keys, F.transform(keys, of)))
    return _SCALAR[fn](valid(c)).cast(scalar_type(dtype))


def column_type(df: DataFrame, c: str) -> T.DataType:
    return df.selectExpr(c).schema[0].dataType


def gmin(c, dtype="double") -> Column:
    return generic("min", c, dtype)


def gmax(c, dtype="double") -> Column:
    return generic("max", c, dtype)


def gsum(c, dtype="double") -> Column:
    return generic("sum", c, dtype)


def gavg(c, dtype="double", nan_policy: str = "ignore") -> Column:
    """Mean of valid values; ``nan_policy="hive"`` counts infinities and gives NaN for NaN only."""
    if nan_policy == "hive":
        d = col(c).cast("double")
        mean = F.avg(F.when(~F.isnan(d), d))
        return F.coalesce(mean, F.when(F.count(d) > 0, F.lit(float("nan")))).cast(dtype)
    return generic("avg", c, dtype)


def aggregate_elements(df: DataFrame, keys: list[str], c: str, fn: str, out: str | None = None) -> DataFrame:
    """Relational form for an array or map column: one row per group with ``out``."""
    dtype, out = column_type(df, c), out or c
    grouped = df.groupBy(*keys).agg(F.count(c).alias("_n"), F.max(F.size(c)).alias("_size"))
    if isinstance(dtype, T.ArrayType):
        parts = df.select(*keys, F.posexplode(c).alias("_at", "_x"))
    else:
        parts = df.select(*keys, F.explode(c).alias("_at", "_x"))
    inner = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype.valueType
    parts = parts.groupBy(*keys, "_at").agg(_SCALAR[fn](valid("_x")).cast(inner).alias("_x"))
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_all"))
    joined = grouped.join(whole, keys, "left")
    if isinstance(dtype, T.ArrayType):
        value = F.transform("_all", lambda s: s["_x"])
    else:
        value = F.map_from_entries("_all")
    empty = F.array() if isinstance(dtype, T.ArrayType) else F.map_from_arrays(F.array(), F.array())
    return joined.select(*keys, F.when(F.col("_n") > 0, F.coalesce(value, empty.cast(dtype))).alias(out))


def most_freq(df: DataFrame, keys: list[str], c: str, index: int | None = None, threshold: float | None = None, prefer: str | None = None, out: str | None = None) -> DataFrame:
    """The most frequent valid value of ``c`` per group, compared and ordered as a string.

    ``prefer`` wins if it occurs. Else values whose share is at least ``threshold``
    are ordered by count, then by string, both descending; of those tied on top
    the one at ``index`` modulo their number is taken, the first without an index.
    Counts are made per value first; what a group gathers is its distinct values.
    """
    dtype = column_type(df, c)
    fractional = isinstance(dtype, (T.FloatType, T.DoubleType))
    item = F.when(is_finite(c), col(c).cast("string")) if fractional else col(c).cast("string")
    counts = df.select(*keys, item.alias("_item")).groupBy(*keys, "_item").agg(F.count("*").alias("_n"))
    sized = F.when(F.col("_item").isNotNull(), F.struct("_n", "_item"))
    whole = counts.groupBy(*keys).agg(
        F.sum(F.when(F.col("_item").isNotNull(), F.col("_n"))).alias("_total"),
        F.max(F.when(F.col("_item") == F.lit(prefer), F.col("_item"))).alias("_liked"),
        F.max("_n" if threshold is None else F.when(F.col("_item").isNotNull(), F.col("_n"))).alias("_top_any"),
        F.sort_array(F.collect_list(sized), asc=False).alias("_all"),
    )
    enough = F.filter("_all", lambda s: F.lit(True) if threshold is None else s["_n"] / F.col("_total") >= F.lit(float(threshold)))
    tied = F.filter(enough, lambda s: s["_n"] == F.get(enough, 0)["_n"])
    chosen = F.get(tied, (F.lit(index or 0) % F.greatest(F.size(tied), F.lit(1))).cast("int"))["_item"]
    return whole.select(*keys, F.coalesce("_liked", chosen).cast(dtype).alias(out or c))


def ordered_sums(df: DataFrame, keys: list[str], c: str, order: list[str], out: str = "sum") -> DataFrame:
    """One row per group with the sum of ``c``, added row by row in the given order.

    Sums of doubles depend on the order, and a plain ``sum`` adds as the rows happen to be split; use this
    where that shows, as when sums are rounded. All rows are exchanged and sorted; no group is held in memory.
    """
    w = Window.partitionBy(*keys).orderBy(*order, c)
    running = F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.lead(F.lit(True)).over(w).isNull()
    return df.select(*keys, running.alias(out), last.alias("_last")).where("_last").drop("_last")


def map_collect(key, value) -> Column:
    """A map of the group's keys and values (the external ``collect``)."""
    return F.map_from_entries(F.collect_list(F.struct(col(key), col(value))))
