"""Top-k series, membership, seeded shuffles and samples, concatenation
(A3, L2, J4, P7, L3, R6, U1, L4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def series_frequency(df: DataFrame, series: str, count_as: str = "frequency") -> DataFrame:
    """Rows per series (A3), partially aggregated before the shuffle."""
    return df.groupBy(series).agg(F.count(F.lit(1)).alias(count_as))


def top_series(df: DataFrame, series: str, k: int = 10, count_as: str = "frequency") -> DataFrame:
    """The ``k`` busiest series, ties broken by id (L2).

    ``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: a per-task
    top-k, then a merge of k rows per task; no full sort.
    """
    return (series_frequency(df, series, count_as)
            .orderBy(F.desc(count_as), F.asc(series)).limit(k))


def keep_series(df: DataFrame, chosen: DataFrame, series: str) -> DataFrame:
    """Rows of the chosen series (J4): a left-semi join. However many series are chosen,
    adaptive execution broadcasts them only if they are measured to be small."""
    return df.join(chosen.select(series), series, "left_semi")


def busiest(df: DataFrame, series: str, k: int = 10) -> DataFrame:
    return keep_series(df, F.broadcast(top_series(df, series, k)), series)  # k rows


def shuffle_key(key_cols, seed: int) -> F.Column:
    """Deterministic, engine-independent pseudo-random key: md5 of ``key:seed``."""
    parts = [F.col(c).cast("string") for c in key_cols] + [F.lit(str(seed))]
    return F.md5(F.concat_ws(":", *parts))


def seeded_shuffle(df: DataFrame, key_cols, seed: int = 42, name: str = "shuffle_key") -> DataFrame:
    """Rows in a seeded pseudo-random order (L3): a distributed range sort on
    the md5 key, which is also kept as a column."""
    return df.withColumn(name, shuffle_key(key_cols, seed)).orderBy(name)


def sample_fraction(df: DataFrame, key_cols, fraction: float, seed: int = 42) -> DataFrame:
    """Deterministic Bernoulli sample (R6): keep a row when the first 32 bits
    of its md5 key fall under ``fraction * 2^32``. A pure filter, no shuffle."""
    h = F.conv(F.substring(shuffle_key(key_cols, seed), 1, 8), 16, 10).cast("long")
    return df.filter(h < F.lit(int(fraction * (1 << 32))))


def concat(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` rows (L4)."""
    return df.limit(n)
