"""Standard scaling with a joinable parameter table.

All series are fitted in one grouped aggregate; the parameters are a long table
``(series..., feature, mean, std, with_mean)`` that can be saved, joined and
inverted. Defaults follow Spark ML's ``StandardScaler``: sample std, no
centring, a zero (or undefined) std scales to 0.0; a column whose values are all
equal has std exactly 0. Unlike the reference, the inverse honours ``with_mean``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _series(series):
    return [series] if isinstance(series, str) else list(series or [])


def fit_scaler(df: DataFrame, series, cols, with_mean: bool = False) -> DataFrame:
    """Mean and sample std of every ``col`` per series (M2)."""
    s = _series(series)
    aggs = []
    for c in cols:
        # zero spread exactly when all values are equal: decided by min = max,
        # not by a merged floating-point variance that can land at 1e-16
        sd = F.when(F.max(c) == F.min(c), F.lit(0.0)).otherwise(F.coalesce(F.stddev_samp(c), F.lit(0.0)))
        aggs += [F.avg(c).alias(f"m__{c}"), sd.alias(f"s__{c}")]
    wide = df.groupBy(*s).agg(*aggs) if s else df.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m__{c}").alias("mean"),
                                 F.col(f"s__{c}").alias("std")) for c in cols])
    return (wide.select(*s, F.explode(entries).alias("p"))
                .select(*s, "p.feature", "p.mean", "p.std", F.lit(with_mean).alias("with_mean")))


def _wide_params(params: DataFrame, series, features) -> DataFrame:
    s = _series(series)
    aggs = []
    for f in features:
        hit = F.col("feature") == F.lit(f)
        aggs += [F.max(F.when(hit, F.col("mean"))).alias(f"m__{f}"),
                 F.max(F.when(hit, F.col("std"))).alias(f"s__{f}")]
    aggs.append(F.max(F.col("with_mean").cast("int")).alias("_wm"))
    return params.groupBy(*s).agg(*aggs) if s else params.agg(*aggs)


def _attach(df, params, series, features):
    s = _series(series)
    w = _wide_params(params, s, features)
    # One row per series: Spark's adaptive execution broadcasts it when its
    # measured size is small and falls back to a (skew-split) shuffle join.
    if s:
        keys = {k: f"_p{i}" for i, k in enumerate(s)}
        same = [F.col(k).eqNullSafe(F.col(n)) for k, n in keys.items()]
        return df.join(w.withColumnsRenamed(keys), same, "left").drop(*keys.values())
    packed = w.select(F.struct(*w.columns).alias("p")).scalar()
    return df.select("*", *[packed[c].alias(c) for c in w.columns])


def apply_scaler(df: DataFrame, params: DataFrame, series, cols) -> DataFrame:
    """Scale ``cols`` in place (M3). Nulls stay null, a zero std gives 0.0, and a
    series without parameters keeps its rows, with nulls."""
    d = _attach(df, params, series, cols)
    for c in cols:
        m = F.when(F.col("_wm") == 1, F.col(f"m__{c}")).otherwise(F.lit(0.0))
        s = F.col(f"s__{c}")
        d = d.withColumn(c, F.when((s == 0) & F.col(c).isNotNull(), F.lit(0.0)).otherwise((F.col(c) - m) / F.nullif(s, F.lit(0.0))))
    return d.drop(*[f"m__{c}" for c in cols], *[f"s__{c}" for c in cols], "_wm")


def inverse_scaler(df: DataFrame, params: DataFrame, series, mapping: dict) -> DataFrame:
    """Undo the scaling (M4/F16): ``v * std (+ mean if centred)``, and the mean
    itself for a column that was constant. Nulls stay null; a series without
    parameters keeps its rows, with nulls.

    ``mapping`` is ``{column: feature}``, so predicted and actual columns can
    share one feature's parameters.
    """
    features = sorted(set(mapping.values()))
    d = _attach(df, params, series, features)
    for c, f in mapping.items():
        m = F.when(F.col("_wm") == 1, F.col(f"m__{f}")).otherwise(F.lit(0.0))
        s = F.col(f"s__{f}")
        d = d.withColumn(c, F.when((s == 0) & F.col(c).isNotNull(), F.col(f"m__{f}")).otherwise(F.col(c) * s + m))
    return d.drop(*[f"m__{f}" for f in features], *[f"s__{f}" for f in features], "_wm")
