"""Time-series operators.

* ``regular_grid``: rows on a fixed step from each series' first stamp to its
  last; only the gaps are generated (from each row and its successor), long
  gaps are cut into pieces so no single array holds a whole gap.
* ``interpolate_time``: linear-in-time interpolation from the nearest valid
  neighbours; leading nulls stay, trailing nulls take the last value.
* diagnostics: gaps, their variance, equal-width histograms, a binned kernel
  density, weekly means, full-window rolling means.
* ``rolling_forecast``: the mean of the previous ``n`` observations as the
  one-step forecast (what an ARIMA(0,0,0)-with-constant refit per step gives).

Per-series ordered steps use the chunked helpers of ``blocks``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.time import epoch_us, week_ending_sunday
from cadence.operators.blocks import (chunk_of, following, framed, materialize, nearest_valid, previous,
                                      row_index)

GAP_PIECE = 100_000  # grid points generated per piece of one gap


def _series(series):
    return [series] if isinstance(series, str) else list(series)


def regular_grid(df: DataFrame, series, ts: str, step_s: float, chunk_us: int | None = None,
                 piece: int = GAP_PIECE, checkpoint: bool = True) -> DataFrame:
    """``asfreq(step)`` per series.

    The grid is anchored at the series' first stamp; rows off the grid are
    dropped; missing steps become rows whose other columns are null. Stamps
    must be unique per series. With ``checkpoint`` the anchored rows and the
    finished grid are each written once to the shared checkpoint folder.
    """
    s = _series(series)
    step_us = int(round(step_s * 1_000_000))
    first = df.groupBy(*s).agg(F.min(ts).alias("_t0"))
    d = (df.join(first, s, "inner")
           .filter(F.pmod(epoch_us(ts) - epoch_us("_t0"), F.lit(step_us)) == 0)
           .drop("_t0"))
    if checkpoint:
        d = materialize(d)
    d = following(d, s, [ts], chunk_of(ts, chunk_us), [ts], "_next")
    gaps = d.select(*s, epoch_us(ts).alias("_a"), epoch_us(f"{ts}_next").alias("_b")).filter("_b is not null")
    gaps = gaps.withColumn("_m", F.floor((F.col("_b") - F.col("_a")) / F.lit(step_us)).cast("long") - 1)
    gaps = gaps.filter("_m > 0")
    pieces = gaps.select(*s, "_a", "_m",
                         F.explode(F.sequence(F.lit(0).cast("long"),
                                              F.floor((F.col("_m") - 1) / F.lit(piece)).cast("long"))).alias("_k"))
    pieces = pieces.repartition(*s, "_a", "_k")  # the pieces of one gap in several tasks
    lo = F.col("_k") * F.lit(piece) + 1
    hi = F.least(F.col("_m"), (F.col("_k") + 1) * F.lit(piece))
    fill = pieces.select(*s, F.explode(F.sequence(lo, hi)).alias("_i"), "_a")
    fill = fill.select(*s, F.timestamp_micros(F.col("_a") + F.col("_i") * F.lit(step_us)).alias(ts))
    grid = d.drop(f"{ts}_next").unionByName(fill, allowMissingColumns=True)
    # the grid is read by several consumers downstream (interpolation, rolling
    # means: a chunk summary plus the rows); write it once
    return materialize(grid) if checkpoint else grid


def interpolate_time(df: DataFrame, series, ts: str, cols, chunk_us: int | None = None,
                     checkpoint: bool = False) -> DataFrame:
    """Fill nulls of ``cols`` linearly in time between the nearest valid
    values (T2); the result columns are doubles. The input is read twice (a
    chunk summary and the rows): pass a written table such as
    :func:`regular_grid`'s output, or ``checkpoint=True``."""
    s, cols = _series(series), list(cols)
    d = df.withColumn("_us", epoch_us(ts))
    if checkpoint:
        d = materialize(d)
    d = nearest_valid(d, s, [ts], chunk_of(ts, chunk_us), cols, "_us")
    for c in cols:
        p, n = F.col(f"{c}_prv"), F.col(f"{c}_nxt")
        slope = (n["v"] - p["v"]) / (n["t"] - p["t"])
        v = (F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
              .when(p.isNull(), F.lit(None).cast("double"))
              .when(n.isNull(), p["v"].cast("double"))
              .otherwise(p["v"] + slope * (F.col("_us") - p["t"])))
        d = d.withColumn(c, v).drop(f"{c}_prv", f"{c}_nxt")
    return d.drop("_us")


def date_grid(spark: SparkSession, start, end, step_s: int, shift_steps: int = 0,
              name: str = "ts", rows_per_partition: int = 1_000_000) -> DataFrame:
    """Fixed-step stamps from ``start`` to ``end`` inclusive (T3), generated by
    ``spark.range`` in parallel; ``shift_steps=-1`` moves every stamp one step
    back. ``start``/``end`` are datetimes or epoch micros."""
    def us(x):
        if isinstance(x, (int,)):
            return x
        return int(round(x.timestamp() * 1_000_000)) if x.tzinfo else \
            int(round((x - x.__class__(1970, 1, 1)).total_seconds() * 1_000_000))
    a, b, step = us(start), us(end), step_s * 1_000_000
    n = (b - a) // step + 1
    parts = max(1, math.ceil(n / rows_per_partition))
    r = spark.range(0, n, 1, parts)
    return r.select(F.timestamp_micros(F.lit(a) + (F.col("id") + shift_steps) * F.lit(step)).alias(name))



def time_diffs(df: DataFrame, series, ts: str, chunk_us: int | None = None, tiebreak: str | None = None,
               name: str = "dt") -> DataFrame:
    """Seconds since the previous row of the series (W5, F13); null first."""
    s = _series(series)
    order = [ts] + ([tiebreak] if tiebreak else [])
    d = previous(df, s, order, chunk_of(ts, chunk_us), [ts], "_prev")
    return d.withColumn(name, (epoch_us(ts) - epoch_us(f"{ts}_prev")) / F.lit(1e6)).drop(f"{ts}_prev")


def gap_stats(diffs: DataFrame, series, dt: str = "dt") -> DataFrame:
    """Count, mean and sample variance of the gaps per series."""
    s = _series(series)
    g = diffs.filter(F.col(dt).isNotNull())
    return g.groupBy(*s).agg(F.count(F.lit(1)).alias("n_gaps"), F.avg(dt).alias("mean_gap"),
                             F.var_samp(dt).alias("var_gap"))


def histogram(df: DataFrame, col: str, bins: int = 50, checkpoint: bool = True) -> DataFrame:
    """Equal-width histogram (A7): ``bins`` bins between min and max (the last
    one closed), zero counts included; ``log_count`` = log10(count).

    The value column is written once (it is read by the range aggregate and by
    the counting pass); the range is one scalar subquery attached as a column;
    the counts are a grouped aggregate over ``bin`` with partial aggregation;
    the ``bins`` edge rows come from ``spark.range``.
    """
    v = df.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if checkpoint:
        v = materialize(v)
    rng = v.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi")).alias("r")).scalar()
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    width = (hi - lo) / F.lit(bins)
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - lo) / width), F.lit(bins - 1))).cast("int")
    counts = v.withColumn("_r", rng).select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    edges = df.sparkSession.range(bins).withColumn("_r", rng).select(
        F.col("id").cast("int").alias("bin"),
        (lo + F.col("id") * width).alias("lo"), (lo + (F.col("id") + 1) * width).alias("hi"))
    out = edges.join(counts, "bin", "left").fillna(0, ["count"])
    return out.withColumn("log_count", F.when(F.col("count") > 0, F.log10("count")))


def kde(df: DataFrame, col: str, points: int = 64, per_bandwidth: int = 16, terms: int = 12, checkpoint: bool = True) -> DataFrame:
    """Gaussian kernel density on ``points`` evenly spaced positions.
    Bandwidth h: Scott's rule, ``std * n^(-1/5)``; null densities where it is null or 0.

    The data is first reduced to bins of ``h / per_bandwidth`` and the moments of the
    values around each bin's centre, up to the power ``terms`` (one grouped aggregate).
    Each bin then gives every position its Taylor sum in Hermite polynomials,
    ``exp(-u^2/2) * sum He_k(u) * moment_k / k!``, so the work is bins x points, not rows
    x points, and the bins' width is no error of its own: what is left out is, of each
    value's kernel, at most ``1.1 * d^(terms+1) / sqrt((terms+1)!)`` of its peak, where
    ``d = 1 / (2 * per_bandwidth)`` (4e-25 as given).
    """
    v = df.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if checkpoint:
        v = materialize(v)
    st = v.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n"),
                        (F.stddev_samp("_v") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("h")).alias("s")).scalar()
    lo, hi, n, h = (F.col(f"_s.{c}") for c in ("lo", "hi", "n", "h"))
    width = h / F.lit(float(per_bandwidth))
    v = v.withColumn("_s", st).withColumn("_bin", F.coalesce(F.floor(F.try_divide(F.col("_v") - lo, width)), F.lit(0)))
    v = v.withColumn("_c", lo + (F.col("_bin") + 0.5) * F.coalesce(width, F.lit(0.0)))
    d = F.coalesce(F.try_divide(F.col("_v") - F.col("_c"), h), F.lit(0.0))
    moments = v.withColumn("_d", d).groupBy("_bin", "_c", "_s").agg(
        F.array(*[F.sum(F.pow("_d", F.lit(float(k)))) / F.lit(float(math.factorial(k))) for k in range(terms + 1)]).alias("_m"))
    at = moments.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = at.withColumn("_x", lo + F.col("point") * (hi - lo) / F.lit(points - 1))
    at = at.withColumn("_u", F.try_divide(F.col("_x") - F.col("_c"), h))
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("before"), F.lit(1.0).alias("he"), F.lit(0.0).alias("k"))
    total = F.aggregate("_m", zero, lambda a, m: F.struct(
        (a["total"] + a["he"] * m).alias("total"), a["he"].alias("before"),
        (F.col("_u") * a["he"] - a["k"] * a["before"]).alias("he"), (a["k"] + 1.0).alias("k")))["total"]
    summed = at.groupBy("point", "_x", "_s").agg(F.sum(F.exp(-0.5 * F.col("_u") * F.col("_u")) * total).alias("_sum"))
    return summed.select("point", F.col("_x").alias("x"), F.try_divide(F.col("_sum"), n * h * F.lit(math.sqrt(2 * math.pi))).alias("density"))


def weekly_mean(df: DataFrame, series, ts: str, cols, fill_empty: bool = True) -> DataFrame:
    """Mean per week ending Sunday (pandas ``'W'``), labelled by that Sunday
    (A9); weeks with no rows between the first and last one are null rows."""
    s = _series(series)
    wk = df.groupBy(*s, F.to_timestamp(week_ending_sunday(ts)).alias(ts)).agg(
        *[F.avg(c).alias(c) for c in cols])
    if not fill_empty:
        return wk
    return regular_grid(wk, s, ts, 7 * 86400)


def rolling_mean_full(df: DataFrame, series, ts: str, col: str, n: int = 56, name: str | None = None,
                      chunk_us: int | None = None) -> DataFrame:
    """``rolling(n).mean()``: mean of the last ``n`` rows, null unless all
    ``n`` hold a value (W6)."""
    s = _series(series)
    name = name or f"{col}_rolling"
    d = row_index(df, s, [ts], chunk_of(ts, chunk_us), "_rn")
    out = framed(d, s, "_rn", -(n - 1), 0, {
        "_m": lambda w: F.avg(col).over(w),
        "_c": lambda w: F.count(col).over(w)})
    return out.withColumn(name, F.when(F.col("_c") == n, F.col("_m"))).drop("_m", "_c", "_rn")


def rolling_forecast(df: DataFrame, series, ts: str, cols, n: int = 7, chunk_us: int | None = None,
                     tiebreak: str | None = None) -> DataFrame:
    """One-step forecast of every ``col``: mean of the previous ``n`` rows
    (W7/T6). Columns ``actual_<c>``, ``predicted_<c>``; the first row of a
    series has no forecast and is left out."""
    s = _series(series)
    order = [ts] + ([tiebreak] if tiebreak else [])
    d = df.select(*s, *order, *cols)
    d = row_index(d, s, order, chunk_of(ts, chunk_us), "_rn")
    exprs = {f"predicted_{c}": (lambda c: lambda w: F.avg(c).over(w))(c) for c in cols}
    exprs["_k"] = lambda w: F.count(F.lit(1)).over(w)
    out = framed(d, s, "_rn", -n, -1, exprs).filter("_k > 0")
    return out.select(*s, ts, *[x for c in cols for x in (F.col(c).alias(f"actual_{c}"), f"predicted_{c}")])
