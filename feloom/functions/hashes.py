"""Functions without a built-in form, as Arrow UDFs over whole batches."""

from __future__ import annotations

import html

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .validity import col

_C1, _C2 = 0xCC9E2D51, 0x1B873593
_MASK = 0xFFFFFFFF
#: Seed of the string hash over UTF-16 units (fixed value).
STRING_SEED = 0xF7CA7FD2


def _rotate(x: int, n: int) -> int:
    return ((x << n) | (x >> (32 - n))) & _MASK


def _scramble(k: int) -> int:
    return (_rotate((k * _C1) & _MASK, 15) * _C2) & _MASK


def _step(h: int, k: int) -> int:
    return (_rotate(h ^ _scramble(k), 13) * 5 + 0xE6546B64) & _MASK


def _finish(h: int, length: int) -> int:
    h ^= length
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & _MASK
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & _MASK
    return h ^ (h >> 16)


def string_hash(text: str, seed: int = STRING_SEED) -> int:
    """MurmurHash3 over pairs of UTF-16 units, the first unit of a pair in the high half."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist()
    h = seed
    for a, b in zip(units[0::2], units[1::2]):
        h = _step(h, ((a << 16) + b) & _MASK)
    if len(units) % 2:
        h ^= _scramble(units[-1])
    return _finish(h, len(units))


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32-bit."""
    whole = len(data) // 4
    h = seed
    for k in np.frombuffer(data, "<u4", whole).tolist():
        h = _step(h, k)
    tail = data[4 * whole :]
    if tail:
        h ^= _scramble(int.from_bytes(tail, "little"))
    return _finish(h, len(data))


def _per_value(function):
    """A string UDF that computes each distinct value of a batch once; NULL stays NULL."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)
        results = np.array([*map(function, distinct), None], dtype=object)
        return pd.Series(results[codes])

    return run


def hash_to_uint32(c) -> Column:
    return _per_value(lambda s: str(string_hash(s)))(col(c))


def murmurhash3_32_positive(c) -> Column:
    return _per_value(lambda s: str(murmur3_32(s.encode("utf-8", "surrogatepass"))))(col(c))


def html_unescape(c) -> Column:
    return _per_value(html.unescape)(col(c))


def hash_items(c) -> Column:
    """Each string of an array by :func:`hash_to_uint32`; a NULL stays one."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        known = {s: str(string_hash(s)) for items in lists if items is not None for s in items if s is not None}
        return lists.map(lambda items: None if items is None else [known.get(s) for s in items])

    return run(col(c))


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """A hash of the values of a row; columns that hold maps, which have no hash, count as JSON."""
    def holds_map(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return any(holds_map(f.dataType) for f in t)
        return isinstance(t, T.MapType) or isinstance(t, T.ArrayType) and holds_map(t.elementType)

    quoted = {c: F.col(f"`{c}`") for c in columns}
    return F.xxhash64(*[F.to_json(F.struct(x)) if holds_map(df.schema[c].dataType) else x for c, x in quoted.items()] or [F.lit(0)])
