"""Named functions: Column builders, SQL functions and macros for SQL strings.

Scalar names are also temporary SQL functions. Those cannot be used inside a
lambda, and aggregates cannot be SQL functions at all, so :func:`expand`
rewrites known names in an SQL string to built-ins; it works anywhere in it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import aggregates, hashes, scalar, validity, vectors

_FINITE = "({0} is not null and not isnan({0}) and abs({0}) < double('inf'))"
_VALID = "case when " + _FINITE + " then cast({0} as double) end"


def _vector(body: str) -> str:
    return "case when size({0}) = size({1}) then zip_with({0}, {1}, (x, y) -> " + body + ") end"


_BOTH = "case when " + _FINITE.replace("{0}", "x") + " and " + _FINITE.replace("{0}", "y") + " then {body} end"
#: SQL text per scalar name, with its arguments as {0}, {1}.
SQL = {
    "isinf": "coalesce(abs({0}) = double('inf'), false)",
    "isfinite": _FINITE,
    "is_uint32": "({0} rlike '^[0-9]{{1,10}}$' and coalesce(try_cast({0} as bigint) <= 4294967295, false))",
    "coomul": _vector(_BOTH.replace("{body}", "x * y")),
    "semisum": _vector(_BOTH.replace("{body}", "(x + y) / 2")),
    "semidiff": _vector(_BOTH.replace("{body}", "(x - y) / 2")),
}
_AGGREGATES = {"gmin": "min", "gmax": "max", "gsum": "sum", "gavg": "avg"}


@dataclass(frozen=True)
class Registered:
    name: str
    kind: str
    build: Callable[..., Column]
    sql_types: tuple[str, str] | None = None


_ALL = [
    Registered("isinf", "scalar", validity.is_inf, ("x double", "boolean")),
    Registered("isfinite", "scalar", validity.is_finite, ("x double", "boolean")),
    Registered("is_uint32", "scalar", scalar.is_uint32, ("x string", "boolean")),
    Registered("coomul", "scalar", vectors.coomul, ("x array<double>, y array<double>", "array<double>")),
    Registered("semisum", "scalar", vectors.semisum, ("x array<double>, y array<double>", "array<double>")),
    Registered("semidiff", "scalar", vectors.semidiff, ("x array<double>, y array<double>", "array<double>")),
    Registered("matmul", "scalar", vectors.matmul),
    Registered("uid64", "scalar", scalar.uid64),
    Registered("uid2user", "scalar", scalar.uid2user),
    Registered("map_join", "scalar", scalar.map_join),
    Registered("map_values_ordered", "scalar", scalar.map_values_ordered),
    Registered("hash_to_uint32", "arrow", hashes.hash_to_uint32),
    Registered("murmurhash3_32_positive", "arrow", hashes.murmurhash3_32_positive),
    Registered("html_unescape", "arrow", hashes.html_unescape),
    *[Registered(n, "aggregate", getattr(aggregates, n)) for n in _AGGREGATES],
]
_ALIASES = {"gmin": "generic_min", "gmax": "generic_max", "gsum": "generic_sum", "gavg": "generic_avg", "isinf": "generic_isinf", "isfinite": "generic_isfinite", "coomul": "generic_coomul", "semisum": "generic_semisum", "semidiff": "generic_semidiff", "matmul": "generic_matmul"}
CATALOG: dict[str, Registered] = {r.name: r for r in _ALL} | {alias: next(r for r in _ALL if r.name == name) for name, alias in _ALIASES.items()}


class UnknownFunction(KeyError):
    pass


def function(name: str) -> Callable[..., Column]:
    if name not in CATALOG:
        raise UnknownFunction(name)
    return CATALOG[name].build


def register_as(spark: SparkSession, name: str, alias: str | None = None, override: bool = True) -> None:
    """Make a scalar function known to SQL, under its name or another."""
    if name not in CATALOG:
        raise UnknownFunction(name)
    r, alias = CATALOG[name], alias or name
    if not override and spark.catalog.functionExists(alias):
        raise ValueError(f"{alias} is registered already")
    if r.kind == "arrow":
        plain = {"hash_to_uint32": lambda s: str(hashes.string_hash(s)), "murmurhash3_32_positive": lambda s: str(hashes.murmur3_32(s.encode("utf-8", "surrogatepass"))), "html_unescape": hashes.html.unescape}
        spark.udf.register(alias, hashes._per_value(plain[r.name]))
    elif r.sql_types:
        arguments, result = r.sql_types
        names = [a.split()[0] for a in arguments.split(", ")]
        inner = [f"{n}0" for n in names]
        body = SQL[r.name].format(*inner)
        for n in names:
            arguments = arguments.replace(f"{n} ", f"{n}0 ")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {alias}({arguments}) RETURNS {result} RETURN {body}")
    else:
        raise ValueError(f"{name} has no SQL function; use its Column builder or expand()")


def register_all(spark: SparkSession) -> list[str]:
    names = [n for n, r in CATALOG.items() if r.kind == "arrow" or r.sql_types]
    for n in names:
        register_as(spark, n)
    return names


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    """Arguments of a call whose parenthesis opens at ``start``, and the place after it."""
    depth, quote, begin, out = 0, "", start + 1, []
    for i in range(start, len(text)):
        ch = text[i]
        if quote:
            quote = "" if ch == quote and text[i - 1] != "\\" else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
            if depth == 0:
                return [*out, text[begin:i].strip()] if text[begin:i].strip() or out else [], i + 1
        elif ch == "," and depth == 1:
            out.append(text[begin:i].strip())
            begin = i + 1
    raise ValueError(f"unbalanced parentheses: {text!r}")


def _aggregate_sql(df: DataFrame | None, fn: str, argument: str) -> str:
    """An aggregate over built-ins; the argument's type, if a frame tells it, decides form and result type."""
    dtype: T.DataType = df.selectExpr(argument).schema[0].dataType if df is not None else T.DoubleType()
    valid = lambda x: _VALID.format(x)
    lists = f"collect_list({argument})"

    def reduced(values: str, kind: str) -> str:
        total = f"aggregate({values}, 0D, (s, x) -> s + x)"
        one = {"min": f"array_min({values})", "max": f"array_max({values})", "sum": f"case when size({values}) > 0 then {total} end", "avg": f"case when size({values}) > 0 then {total} / size({values}) end"}[fn]
        return f"cast({one} as {kind})"

    if isinstance(dtype, T.ArrayType):
        size = f"array_max(transform({lists}, a -> size(a)))"
        items = f"filter(transform({lists}, a -> {valid('get(a, i)')}), x -> x is not null)"
        made = f"transform(sequence(0, {size} - 1), i -> {reduced(items, dtype.elementType.simpleString())})"
        return f"case when {size} > 0 then {made} when {size} = 0 then cast(array() as {dtype.simpleString()}) end"
    if isinstance(dtype, T.MapType):
        keys = f"array_sort(array_distinct(flatten(transform({lists}, m -> map_keys(m)))))"
        items = f"filter(transform({lists}, m -> {valid('try_element_at(m, k)')}), x -> x is not null)"
        return f"case when size({lists}) > 0 then map_from_arrays({keys}, transform({keys}, k -> {reduced(items, dtype.valueType.simpleString())})) end"
    return f"cast({fn}({valid(f'({argument})')}) as {aggregates.scalar_type(dtype).simpleString()})"


def expand(sql: str, df: DataFrame | None = None) -> str:
    """An SQL expression with the known names replaced by built-ins, innermost first."""
    at = 0
    pattern = re.compile(r"(?<![\w.`])(" + "|".join([*SQL, *_AGGREGATES, *(_ALIASES[n] for n in [*_AGGREGATES, *SQL] if n in _ALIASES)]) + r")\s*\(", re.I)
    while found := pattern.search(sql, at):
        if sql[: found.start()].count("'") % 2:
            at = found.end()
            continue
        name = found[1].lower()
        name = next((n for n, a in _ALIASES.items() if a == name), name)
        arguments, end = _arguments(sql, found.end() - 1)
        inner = [expand(a, df) for a in arguments]
        if name in _AGGREGATES:
            made = _aggregate_sql(df, _AGGREGATES[name], inner[0])
        else:
            made = SQL[name].format(*inner)
        sql = sql[: found.start()] + made + sql[end:]
        at = found.start() + len(made)
    return sql


def grouped(df: DataFrame, keys: list[str], expressions: dict[str, str]) -> DataFrame:
    """``groupBy(keys)`` with SQL strings, which may use the names of this module."""
    return df.groupBy(*keys).agg(*[F.expr(expand(e, df)).alias(n) for n, e in expressions.items()])
