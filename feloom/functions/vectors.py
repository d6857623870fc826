"""Element-wise vector functions and products of square matrices stored row by row.

Arithmetic is in double; the result keeps the element type given. An invalid
operand makes a NULL element; vectors of different sizes make a NULL result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .validity import col, valid


def _pairwise(a, b, f: Callable[[Column, Column], Column], dtype: str) -> Column:
    a, b = col(a), col(b)
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: valid(f(valid(x), valid(y))).cast(dtype)))


def coomul(a, b, dtype: str = "double") -> Column:
    """Product of the elements at each place."""
    return _pairwise(a, b, lambda x, y: x * y, dtype)


def semisum(a, b, dtype: str = "double") -> Column:
    """Half the sum at each place."""
    return _pairwise(a, b, lambda x, y: (x + y) / 2, dtype)


def semidiff(a, b, dtype: str = "double") -> Column:
    """Half the difference at each place."""
    return _pairwise(a, b, lambda x, y: (x - y) / 2, dtype)


def matmul(a, b, dtype: str = "double") -> Column:
    """Matrix times matrix (equal square sizes) or matrix times vector; else NULL.

    An invalid element makes NULL each cell whose dot product it enters.
    """
    a, b = col(a), col(b)
    na, nb = F.size(a), F.size(b)
    side = F.floor(F.sqrt(na.cast("double")) + 0.5).cast("int")
    square = side * side == na
    columns = F.when(nb == na, side).otherwise(F.lit(1))

    def cell(i: Column) -> Column:
        row, column = F.floor(i / columns).cast("int"), (i % columns).cast("int")
        terms = F.transform(F.sequence(F.lit(0), side - 1), lambda k: valid(F.get(a, row * side + k)) * valid(F.get(b, k * columns + column)))
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).cast(dtype)

    product = F.transform(F.sequence(F.lit(0), side * columns - 1), cell)
    empty = F.array().cast(f"array<{dtype}>")
    return F.when((na == 0) & (nb == 0), empty).when((na > 0) & square & ((nb == na) | (nb == side)), product)
