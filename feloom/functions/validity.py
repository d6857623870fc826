"""Valid values: a number is valid if it is neither NULL nor NaN nor infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_inf(c) -> Column:
    """True for both infinities, never NULL."""
    return F.coalesce(F.abs(col(c)) == F.lit(_INF), F.lit(False))


def is_finite(c) -> Column:
    """False for NULL, NaN and infinities, never NULL."""
    c = col(c)
    return c.isNotNull() & F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(_INF)), F.lit(False))


def valid(c) -> Column:
    """The value as a double, or NULL if it is invalid."""
    d = col(c).cast("double")
    return F.when(is_finite(d), d)


def invalid_to_zero(c) -> Column:
    return F.coalesce(valid(c), F.lit(0.0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), 0)
