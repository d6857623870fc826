"""Differences between two datasets with one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import almost_equal
from .joins import pack_and_join


def _differs(l: Column, r: Column, t: T.DataType, eps: float) -> Column:
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return ~almost_equal(l, r, eps)
    if isinstance(t, T.ArrayType):
        sizes = ~F.size(l).eqNullSafe(F.size(r))
        pairs = F.zip_with(l, r, lambda x, y: _differs(x, y, t.elementType, eps))
        return sizes | F.coalesce(F.exists(pairs, lambda x: x), F.lit(False))
    if isinstance(t, T.MapType):
        keys = F.array_union(F.coalesce(F.map_keys(l), F.array()), F.coalesce(F.map_keys(r), F.array()))
        uneven = F.exists(keys, lambda k: F.coalesce(F.map_contains_key(l, k), F.lit(False)) != F.coalesce(F.map_contains_key(r, k), F.lit(False)))
        values = F.exists(keys, lambda k: _differs(F.try_element_at(l, k), F.try_element_at(r, k), t.valueType, eps))
        return ~l.isNull().eqNullSafe(r.isNull()) | F.coalesce(uneven | values, F.lit(False))
    return ~l.eqNullSafe(r)


def check_schemas(left: DataFrame, right: DataFrame) -> None:
    a, b = ({f.name: f.dataType for f in df.schema} for df in (left, right))
    if a != b:
        raise ValueError(f"different schemas: {sorted(set(map(str, a.items())) ^ set(map(str, b.items())))}")


def dataset_diff(left: DataFrame, right: DataFrame, on: list[str], eps: float = 1e-5) -> DataFrame:
    """Keys whose rows differ, with the names of the columns that do; a missing side is ``only_left`` or ``only_right``."""
    check_schemas(left, right.select(*left.columns))
    names = []
    for f in left.schema:
        if f.name not in on:
            names.append(F.when(_differs(F.col(f"l.{f.name}"), F.col(f"r.{f.name}"), f.dataType, eps), F.lit(f.name)))
    both = pack_and_join(left, right.select(*left.columns), on)
    text = F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").otherwise(F.concat_ws(",", *names))
    return both.select(*on, text.alias("diff")).where("diff <> ''")


def dataset_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.agg(F.count("*").alias("n_left")).crossJoin(right.agg(F.count("*").alias("n_right")))
