"""Aggregation of feature rows by configured pipelines, one per column and, if wanted, per feature.

A pipeline is a list of stages ``{"type": "filter", "name": "drop_null"}`` or
``{"type": "agg", "name": ..., "parameters": {...}}``; aggregates are ``avg``
(``null``: ``drop`` or a number in place of invalid values), ``min``, ``max``,
``sum`` and ``most_freq`` (``rnd_value``: index among the tied). The key
``domain`` is the default of a column's features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.validity import let, valid

DEFAULT = [{"type": "agg", "name": "avg", "parameters": {"null": "drop"}}]
#: The first name is historical: it replaces invalid values by 0.
ZERO_FILTERS = ("drop_null", "invalid_to_zero")


def _run(values: Column, stages: list[dict]) -> Column:
    """One value of an array of raw values (doubles, may be invalid or NULL)."""
    for stage in stages:
        if stage["type"] == "filter":
            if stage["name"] not in ZERO_FILTERS:
                raise ValueError(f"unknown filter {stage['name']!r}")
            values = F.transform(values, lambda x: F.coalesce(valid(x), F.lit(0.0)))
            continue
        name, given = stage["name"], stage.get("parameters") or {}
        if name == "avg" and str(given.get("null", "drop")) != "drop":
            fill = float(given["null"]) if _is_number(given["null"]) else 0.0
            values = F.transform(values, lambda x: F.coalesce(valid(x), F.lit(fill)))
        good = F.filter(F.transform(values, valid), lambda x: x.isNotNull())
        values = F.array(let(good, _reducer(name, given)))
    return F.get(values, 0)


def _reducer(name: str, given: dict):
    """From an array of valid doubles to one value."""
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda s, x: s + x)
    known = {
        "avg": lambda g: F.when(F.size(g) > 0, total(g) / F.size(g)),
        "sum": lambda g: F.when(F.size(g) > 0, total(g)),
        "min": F.array_min,
        "max": F.array_max,
        "most_freq": lambda g: _most_freq(g, int(given.get("rnd_value") or 0)),
    }
    if name not in known:
        raise ValueError(f"unknown aggregate {name!r}")
    return known[name]


def _is_number(x) -> bool:
    try:
        float(x)
    except (TypeError, ValueError):
        return False
    return True


def _most_freq(good: Column, index: int) -> Column:
    """Count descending, value ascending; the index is taken modulo the number of tied values."""

    def of_sorted(ordered: Column) -> Column:
        n = F.size(ordered)
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))

        def of_begins(at: Column) -> Column:
            ends = F.concat(F.slice(at, 2, F.greatest(n, F.lit(1))), F.array(n))
            runs = F.zip_with(at, ends, lambda a, b: F.struct((b - a).alias("n"), F.get(ordered, a).alias("d")))
            return let(runs, lambda r: let(F.array_max(F.transform(r, lambda c: c["n"])), lambda top: _at(F.filter(r, lambda c: c["n"] == top), index)))

        return let(begins, of_begins)

    return F.when(F.size(good) > 0, let(F.array_sort(good), of_sorted))


def _at(tied: Column, index: int) -> Column:
    return F.get(tied, (F.lit(index) % F.greatest(F.size(tied), F.lit(1))).cast("int"))["d"]


def _single(name: str, stages: list[dict]) -> Column | None:
    """A scalar pipeline of one aggregate, as a built-in with partial aggregation."""
    x = F.col(name)
    rest = list(stages)
    zero = False
    while rest and rest[0]["type"] == "filter" and rest[0]["name"] in ZERO_FILTERS:
        zero = True
        rest = rest[1:]
    if len(rest) != 1 or rest[0]["type"] != "agg":
        return None
    agg, given = rest[0]["name"], rest[0].get("parameters") or {}
    v = valid(x)
    if zero:
        v = F.coalesce(v, F.lit(0.0))
    elif agg == "avg" and str(given.get("null", "drop")) != "drop":
        v = F.coalesce(v, F.lit(float(given["null"]) if _is_number(given["null"]) else 0.0))
    if agg == "most_freq" and not int(given.get("rnd_value") or 0):
        return F.mode(v, True)
    return {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}.get(agg, lambda _: None)(v)


def _stages(config: dict, feature: str | None = None) -> list[dict]:
    return config.get(feature) or config.get("domain") or DEFAULT


def _array_pipeline(name: str, cfg: dict) -> Column:
    lists = F.collect_list(name)
    size = F.array_max(F.transform(lists, F.size))
    special = {int(k): v for k, v in cfg.items() if k != "domain"}

    def at(i: Column) -> Column:
        raw = F.transform(lists, lambda a: F.get(a, i).cast("double"))
        value = _run(raw, _stages(cfg))
        for k, stages in special.items():
            value = F.when(i == k, _run(raw, stages)).otherwise(value)
        return value.cast("float")

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), at))


def _map_pipeline(name: str, cfg: dict) -> Column:
    maps = F.collect_list(name)
    names = F.array_sort(F.array_distinct(F.flatten(F.transform(maps, F.map_keys))))
    special = {k: v for k, v in cfg.items() if k != "domain"}

    def of(key: Column) -> Column:
        raw = F.transform(maps, lambda m: F.try_element_at(m, key).cast("double"))
        value = _run(raw, _stages(cfg))
        for k, stages in special.items():
            value = F.when(key.cast("string") == k, _run(raw, stages)).otherwise(value)
        return value.cast("float")

    whole = F.map_filter(F.map_from_arrays(names, F.transform(names, of)), lambda k, v: v.isNotNull())
    return F.when(F.size(whole) > 0, whole)


def aggregate_columns(df: DataFrame, config: dict[str, dict], keys: list[str]) -> DataFrame:
    """One row per key. Scalars give a float; arrays are as long as the group's longest;
    maps lose keys without a value, and become NULL without any."""
    made = []
    for f in df.schema:
        if f.name in keys:
            continue
        cfg = config.get(f.name, {})
        if isinstance(f.dataType, T.ArrayType):
            value = _array_pipeline(f.name, cfg)
        elif isinstance(f.dataType, T.MapType):
            value = _map_pipeline(f.name, cfg)
        else:
            stages = _stages(cfg, f.name)
            value = _single(f.name, stages)
            if value is None:
                rows = F.collect_list(F.struct(F.col(f.name).cast("double").alias("x")))
                value = _run(F.transform(rows, lambda r: r["x"]), stages).cast("float")
            value = value.cast("float")
        made.append(value.alias(f.name))
    return df.groupBy(*keys).agg(*made)
