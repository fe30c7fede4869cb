"""Array arithmetic as higher-order SQL functions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Sum of element-wise products of two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def matrix(rows: int, cols: int, item) -> Column:
    """An array of ``rows`` arrays of ``item(row, column)``."""
    return F.array(*[F.array(*[item(i, j) for j in range(cols)]) for i in range(rows)])


def each(a: Column, b: Column, f) -> Column:
    """``f`` of every two numbers of two matrices of one shape."""
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, f))
