"""Feature layouts: dense array, sparse map and prefixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import array_firstk, is_uint32, map_topk, merge_maps
from ..functions.hashes import hash_items
from ..functions.validity import is_finite

KEYS = ("uid", "uid_type", "dt")


def _data(df: DataFrame, keys) -> list[T.StructField]:
    return [f for f in df.schema if f.name not in keys]


def _keys(df: DataFrame, keys) -> list[str]:
    return [c for c in df.columns if c in keys]


def is_primitive(t: T.DataType) -> bool:
    return not isinstance(t, (T.ArrayType, T.MapType, T.StructType))


def prefix_domain(df: DataFrame, name: str, cast: str | None = None, keys=KEYS) -> DataFrame:
    """Each data column as ``name_column``."""
    made = [(F.col(f.name).cast(cast) if cast else F.col(f.name)).alias(f"{name}_{f.name}") for f in _data(df, keys)]
    return df.select(*_keys(df, keys), *made)


def array_sizes(df: DataFrame, columns: list[str]) -> dict[str, tuple[int | None, int | None]]:
    """Smallest and largest size of each array column, in one pass."""
    if not columns:
        return {}
    row = df.agg(*[f(F.size(c)).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(columns)}


def array_domain(df: DataFrame, name: str, element: str = "float", keys=KEYS, sizes: dict[str, int] | None = None, pad: bool = False, strict: bool = False) -> DataFrame:
    """Primitive columns first as one array, then the array columns; map columns are ignored.

    A NULL array becomes as many NULLs as the column's largest array. ``pad``
    (the newer rule) also fills short arrays up to it and rejects map columns;
    ``strict`` rejects arrays of different sizes. A column whose arrays are all
    NULL is an error unless there are no rows.
    """
    data = _data(df, keys)
    arrays = [f.name for f in data if isinstance(f.dataType, T.ArrayType)]
    if pad and any(not is_primitive(f.dataType) and f.name not in arrays for f in data):
        raise ValueError("an array domain takes primitive and array columns")
    found = {c: (None, s) for c, s in sizes.items()} if sizes else array_sizes(df, arrays)
    if strict and any(lo != hi for lo, hi in found.values()):
        raise ValueError(f"arrays of different sizes: {found}")
    if any(found[c][1] is None for c in arrays) and not df.isEmpty():
        raise ValueError("the size of an array column is unknown")
    parts = []
    singles = [F.col(f.name).cast(element) for f in data if is_primitive(f.dataType)]
    if singles:
        parts.append(F.array(*singles))
    for c in arrays:
        size = found[c][1] or 0
        nulls = F.array_repeat(F.lit(None).cast(element), size)
        value = F.col(c).cast(f"array<{element}>")
        if pad:
            value = F.concat(value, F.array_repeat(F.lit(None).cast(element), F.greatest(F.lit(0), F.lit(size) - F.size(c))))
        parts.append(F.coalesce(value, nulls))
    whole = F.concat(*parts) if parts else F.array().cast(f"array<{element}>")
    return df.select(*_keys(df, keys), F.when(F.exists(whole, lambda x: x.isNotNull()), whole).alias(name))


def map_domain(df: DataFrame, name: str, value: str = "float", keys=KEYS) -> DataFrame:
    """Primitive columns as entries and all map columns merged, the last one wins; NULL values go, arrays are ignored."""
    data = _data(df, keys)
    parts: list[Column] = []
    singles = [f.name for f in data if is_primitive(f.dataType)]
    kind = f"map<string,{value}>"
    if singles:
        parts.append(F.create_map(*[x for c in singles for x in (F.lit(c), F.col(c).cast(value))]).cast(kind))
    for f in data:
        if isinstance(f.dataType, T.MapType):
            parts.append(F.coalesce(F.col(f.name).cast(kind), F.map_from_arrays(F.array(), F.array()).cast(kind)))
    parts = [F.map_filter(p, lambda k, v: v.isNotNull()) for p in parts]
    whole = merge_maps(*parts) if parts else F.map_from_arrays(F.array(), F.array()).cast(kind)
    return df.select(*_keys(df, keys), F.when(F.size(whole) > 0, whole).alias(name))


def build_domain(df: DataFrame, name: str, layout: str, extra: str | None = None, keys=KEYS, **options) -> DataFrame:
    """A domain of the given layout; ``extra`` is SQL over the finished collection, cast to its type."""
    if layout == "prefix":
        if extra:
            raise ValueError("a prefix domain takes no extra expression")
        return prefix_domain(df, name, keys=keys, **options)
    made = {"array": array_domain, "map": map_domain}[layout](df, name, keys=keys, **options)
    return made.withColumn(name, F.expr(extra).cast(made.schema[name].dataType)) if extra else made


def explode_uids(df: DataFrame, uids: dict[str, str]) -> DataFrame:
    """One row per id: ``uids`` maps a type expression to an id expression; rows with a NULL id go."""
    pairs = F.array(*[F.struct(F.expr(t).cast("string").alias("t"), F.expr(u).cast("string").alias("u")) for t, u in uids.items()])
    rest = [c for c in df.columns if c not in ("uid", "uid_type")]
    made = df.select(*rest, F.explode(pairs).alias("_id"))
    return made.select(F.col("_id.u").alias("uid"), F.col("_id.t").alias("uid_type"), *rest).where("uid is not null")


def source_struct(df: DataFrame, name: str, keys=KEYS) -> DataFrame:
    """All data columns packed in one struct, so that domains can name them ``name.column``."""
    return df.select(*_keys(df, keys), F.struct(*[f.name for f in _data(df, keys)]).alias(name))


def transform_feature(df: DataFrame, feature: str, max_size: int = 1000, hashing: bool = False) -> DataFrame:
    """Route a feature to one of ``score, score_list, score_map, cat_list``; the others are NULL.

    Numbers are cast to float, a string to a list of one. A row stays only if it has no NULL, and

    - its number is finite,
    - its list of numbers has an item and all are finite,
    - its list of strings has an item, none is NULL, and all are uint32,
    - its map has a finite value whose key is a uint32; its other entries go.

    ``hashing`` turns strings and keys into uint32 instead of asking for them. Lists
    keep their first, maps their largest ``max_size`` entries.
    """
    t, x = df.schema[feature].dataType, F.col(feature)
    none = {"score": "float", "score_list": "array<float>", "score_map": "map<string,float>", "cat_list": "array<string>"}
    is_id = lambda s: F.coalesce(is_uint32(s), F.lit(False))
    rows = df.dropna()
    if isinstance(t, T.MapType):
        target = "score_map"
        entries = F.filter(F.map_entries(x.cast("map<string,float>")), lambda e: is_finite(e["value"]))
        if hashing:
            rows = rows.withColumn("_e", entries).withColumn("_k", hash_items(F.transform("_e", lambda e: e["key"])))
            entries = F.zip_with("_k", "_e", lambda k, e: F.struct(k.alias("key"), e["value"].alias("value")))
        else:
            entries = F.filter(entries, lambda e: is_id(e["key"]))
        rows = rows.withColumn("_x", map_topk(F.map_from_entries(entries), max_size)).where(F.size("_x") > 0).drop("_e", "_k")
    elif isinstance(t, T.StringType) or isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
        target = "cat_list"
        items = F.array(x) if isinstance(t, T.StringType) else x
        rows = rows.where((F.size(items) > 0) & ~F.exists(items, lambda s: s.isNull()))
        rows = rows.withColumn("_x", array_firstk(hash_items(items), max_size)) if hashing else rows.where(F.forall(items, is_id)).withColumn("_x", array_firstk(items, max_size))
    elif isinstance(t, T.ArrayType):
        target = "score_list"
        rows = rows.withColumn("_x", x.cast("array<float>")).where((F.size("_x") > 0) & F.forall("_x", lambda v: F.coalesce(is_finite(v), F.lit(False))))
        rows = rows.withColumn("_x", array_firstk("_x", max_size))
    else:
        target = "score"
        rows = rows.withColumn("_x", x.cast("float")).where(is_finite("_x"))
    return rows.withColumns({n: F.col("_x") if n == target else F.lit(None).cast(kind) for n, kind in none.items()}).drop("_x")


# Grouped features: an ordered list of (column, keys) that names a dense vector


def dense_vector(groups: list[tuple[str, list]], schema: T.StructType) -> Column:
    """The vector of a row. Maps: a missing key is 0, a NULL value NaN. Arrays: a missing or NULL item is NaN."""
    nan = F.lit(float("nan"))
    parts = []
    for column, wanted in groups:
        x = F.col(column)
        if isinstance(schema[column].dataType, T.MapType):
            kind = schema[column].dataType.keyType
            for k in wanted:
                key = F.lit(k).cast(kind)
                there = F.coalesce(F.map_contains_key(x, key), F.lit(False))
                parts.append(F.when(there, F.coalesce(F.try_element_at(x, key).cast("double"), nan)).otherwise(F.lit(0.0)))
        else:
            parts += [F.coalesce(F.get(x, int(k)).cast("double"), nan) for k in wanted]
    return F.array(*parts)


def merge_groups(models: list[list[tuple[str, list]]]) -> list[tuple[str, list]]:
    """The union of the models' features: keys distinct and sorted as strings, columns in order of appearance."""
    keys: dict[str, set] = {}
    for groups in models:
        for column, wanted in groups:
            keys.setdefault(column, set()).update(map(str, wanted))
    return [(c, sorted(k)) for c, k in keys.items()]


def group_indices(groups: list[tuple[str, list]], merged: list[tuple[str, list]]) -> list[int]:
    """Where each feature of a model stands in the merged vector."""
    place, at = {}, 0
    for column, wanted in merged:
        for k in wanted:
            place[column, str(k)] = at
            at += 1
    return [place[c, str(k)] for c, wanted in groups for k in wanted]


def slice_vector(vector: Column, indices: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, indices)), lambda i: F.get(vector, i))
