"""Per-interval workload features and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions.names import category_columns
from cadence.functions.time import bucket_start


def workload_features(df: DataFrame, series, ts: str, unit: str = "second",
                      count_as: str = "invocations", means=(), keep=(), extra: dict | None = None,
                      out_ts: str | None = None) -> DataFrame:
    """One row per (series, interval): count, ``avg_<c>`` for ``means``,
    ``max`` of functionally dependent columns ``keep`` (deterministic stand-in
    for ``first``), plus any ``extra`` aggregates.

    A hash aggregate with map-side partial aggregation: a hot series is
    pre-aggregated in every task before the shuffle.
    """
    series = [series] if isinstance(series, str) else list(series)
    out_ts = out_ts or ts
    aggs = [F.count(F.lit(1)).alias(count_as)]
    aggs += [F.avg(c).alias(f"avg_{c}") for c in means]
    aggs += [F.max(c).alias(c) for c in keep]
    aggs += [v.alias(k) for k, v in (extra or {}).items()]
    return df.groupBy(*series, bucket_start(ts, unit).alias(out_ts)).agg(*aggs)


def distinct_values(df: DataFrame, col: str) -> list:
    """Sorted distinct non-null values of a category column.

    One aggregate. The list becomes the columns of a wide table, so it is as long
    as that table's schema; :func:`one_hot_long` needs no list.
    """
    return [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).collect()]


def distinct_pairs(df: DataFrame, a: str, b: str) -> list[tuple]:
    """Distinct ``(a, b)`` value pairs in one aggregate (A5 for two category
    columns at once); for column lists, as :func:`distinct_values`."""
    return [(r[0], r[1]) for r in df.select(a, b).distinct().collect()]


def distinct_rows(df: DataFrame, cols) -> DataFrame:
    """``SELECT DISTINCT cols`` as a DataFrame."""
    return df.select(*cols).distinct()


def one_hot(df: DataFrame, col: str, prefix: str, categories=None, drop: bool = False) -> DataFrame:
    """Append one 0/1 int column per category, named ``prefix + value`` with
    dots turned into underscores (R2)."""
    if categories is None:
        categories = distinct_values(df, col)
    out = df.select("*", *category_columns(col, prefix, categories))
    return out.drop(col) if drop else out


def one_hot_long(df: DataFrame, ids, col: str) -> DataFrame:
    """The ones of a one-hot table as rows (R2 for open-ended categories): ``ids``,
    ``category`` and ``hit`` = 1; nulls have no category. No list, no shuffle."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    return df.where(F.col(col).isNotNull()).select(*ids, F.col(col).alias("category"), F.lit(1).alias("hit"))


def melt_nonzero(df: DataFrame, ids, value_cols, var: str = "minute", value: str = "invocations",
                 keep_null: bool = True) -> DataFrame:
    """Wide -> long over ``value_cols``, dropping zero cells (R1 + P11).

    Null cells are kept (``keep_null``): the reference's ``!= 0`` test keeps
    them. ``unpivot`` is a generator inside the scan stage; no shuffle.
    """
    long = df.unpivot(list(ids), list(value_cols), var, value)
    cond = F.col(value) != 0
    if keep_null:
        cond = cond | F.col(value).isNull()
    return long.filter(cond)
