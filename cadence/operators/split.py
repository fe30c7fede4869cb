"""Time and position splits.

Per-series positions come from :func:`cadence.operators.blocks.row_index`,
per-series totals from a grouped count joined back, so no step needs a whole
series in one task.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.blocks import chunk_of, row_index


def _series(series):
    if series is None:
        return []
    return [series] if isinstance(series, str) else list(series)


def time_holdout(df: DataFrame, ts: str, series=None, days: int = 7, split_col: str = "split",
                 date_col: str = "date") -> DataFrame:
    """Last ``days`` days (counted from the max date) are ``test``.

    ``date < max_date - days`` is train, ``>=`` test (8 calendar dates for
    ``days=7``). Rows with a null date fall in neither and are dropped. The max
    date is per series when ``series`` is given (a grouped max joined back),
    else global (a scalar subquery, computed once).
    """
    s = _series(series)
    d = df.withColumn(date_col, F.to_date(ts)).filter(F.col(date_col).isNotNull())
    if s:
        mx = d.groupBy(*s).agg(F.max(date_col).alias("_max_date"))
        d = d.join(mx, s, "inner")
    else:
        d = d.withColumn("_max_date", d.agg(F.max(date_col)).scalar())
    cutoff = F.date_sub(F.col("_max_date"), days)
    return (d.withColumn(split_col, F.when(F.col(date_col) < cutoff, F.lit("train")).otherwise(F.lit("test")))
             .drop("_max_date"))


def _ordered(df, series, ts, tiebreak, chunk_us):
    """Position ``_rn`` and series length ``_n`` from one chunked pass."""
    order = [ts] + ([tiebreak] if tiebreak else [])
    return row_index(df, series, order, chunk_of(ts, chunk_us), "_rn", total="_n")


def tail_holdout(df: DataFrame, series, ts: str, fraction: float = 0.2, tiebreak: str | None = None,
                 split_col: str = "split", chunk_us: int | None = None) -> DataFrame:
    """Last ``fraction`` of each series in time order is ``val`` (R4):
    row ``rn`` is train when ``rn <= floor(n * (1 - fraction))`` (exact
    rational arithmetic)."""
    s = _series(series)
    fr = Fraction(str(fraction))
    d = _ordered(df, s, ts, tiebreak, chunk_us)
    n_train = F.expr(f"(_n * {fr.denominator - fr.numerator}) div {fr.denominator}")
    return (d.withColumn(split_col, F.when(F.col("_rn") <= n_train, F.lit("train")).otherwise(F.lit("val")))
             .drop("_rn", "_n"))


def shards(df: DataFrame, series, ts: str, n_shards: int, tiebreak: str | None = None,
           shard_col: str = "shard", chunk_us: int | None = None) -> DataFrame:
    """Contiguous, near-equal shards 1..N of each series in time order (R5),
    the same numbering as ``ntile(N)``: the first ``n mod N`` shards get one
    extra row."""
    s = _series(series)
    d = _ordered(df, s, ts, tiebreak, chunk_us)
    N = F.lit(n_shards)
    size = F.floor(F.col("_n") / N)
    rem = F.col("_n") - size * N
    big = rem * (size + 1)
    shard = (F.when(F.col("_rn") <= big, F.floor((F.col("_rn") - 1) / (size + 1)) + 1)
              .otherwise(rem + F.floor((F.col("_rn") - big - 1) / size) + 1))
    return d.withColumn(shard_col, shard.cast("int")).drop("_rn", "_n")


def shards_global(df: DataFrame, order: str, n_shards: int, tiebreak: str | None = None,
                  shard_col: str = "shard") -> DataFrame:
    """Contiguous, near-equal shards 1..N of the whole table in order (R5): ``ntile(N)``
    without a window over all rows. Rows are numbered range by range and corrected
    by the counts of the ranges before (one summary row a range). Written with
    ``partition_by`` the shard column, a client reads its shard alone."""
    d = df.withColumn("_all", F.lit(0))
    return shards(d, "_all", order, n_shards, tiebreak, shard_col).drop("_all")


def last_n(df: DataFrame, series, ts: str, n: int, skip: int = 0, tiebreak: str | None = None,
           chunk_us: int | None = None) -> DataFrame:
    """Rows ``[-(n+skip) : -skip]`` of each series in time order."""
    s = _series(series)
    d = _ordered(df, s, ts, tiebreak, chunk_us)
    back = F.col("_n") - F.col("_rn") + 1
    return d.filter((back > skip) & (back <= skip + n)).drop("_rn", "_n")


def time_cut(df: DataFrame, ts: str, at, split_col: str = "split") -> DataFrame:
    """``ts < at`` train, ``ts >= at`` val (P8); no row is lost at ``at``."""
    return df.withColumn(split_col, F.when(F.col(ts) < F.lit(at).cast("timestamp"), "train").otherwise("val"))


def time_slice(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """Inclusive label slice ``loc[start:end]``."""
    c = F.lit(True)
    if start is not None:
        c = c & (F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        c = c & (F.col(ts) <= F.lit(end).cast("timestamp"))
    return df.filter(c)


def year_slice(df: DataFrame, ts: str, first_year: int, last_year: int) -> DataFrame:
    """Label slice by years, ``["2022":"2024"]`` (P9): from the first instant
    of ``first_year`` to before the first instant of ``last_year + 1``; a plain
    range predicate, pushed down to the scan."""
    lo = F.lit(f"{first_year:04d}-01-01 00:00:00").cast("timestamp")
    hi = F.lit(f"{last_year + 1:04d}-01-01 00:00:00").cast("timestamp")
    return df.filter((F.col(ts) >= lo) & (F.col(ts) < hi))
