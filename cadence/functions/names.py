"""Column names made from data values."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F


def one_hot_name(prefix: str, value) -> str:
    """``e_vers_`` + ``0.3.4`` -> ``e_vers_0_3_4``: dots become underscores."""
    return f"{prefix}{str(value).replace('.', '_')}"


def category_columns(col: str, prefix: str, categories) -> list[Column]:
    """One 0/1 int column per category, named from the value.

    A null category gives 0 in every column (the row matches none).
    """
    out = []
    for v in categories:
        name = one_hot_name(prefix, v)
        out.append(F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)).alias(name))
    return out
