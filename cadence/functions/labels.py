"""Label matchers on a ``MAP<STRING,STRING>`` labels column.

Semantics of a metric selector: regex matchers are anchored at both ends and a
missing label reads as the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(key: str, labels: str = "labels") -> Column:
    return F.coalesce(F.try_element_at(F.col(labels), F.lit(key)), F.lit(""))


def label_match(key: str, op: str, value: str, labels: str = "labels") -> Column:
    """One matcher: ``=``, ``!=``, ``=~`` or ``!~``."""
    v = label(key, labels)
    if op == "=":
        return v == F.lit(value)
    if op == "!=":
        return v != F.lit(value)
    anchored = f"^(?:{value})$"
    if op == "=~":
        return v.rlike(anchored)
    if op == "!~":
        return ~v.rlike(anchored)
    raise ValueError(f"unknown matcher {op!r}")
