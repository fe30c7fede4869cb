"""Prediction tables and forecast metrics.

Metrics are plain aggregates over a prediction table, so they run per series,
per client or globally with one grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.blocks import chunk_of, row_index


def _keys(by):
    return [by] if isinstance(by, str) else list(by or [])


def prediction_table(actual: DataFrame, predicted: DataFrame, keys, pairs: dict) -> DataFrame:
    """Align forecasts with actuals on ``keys`` (e.g. series and timestamp)
    (M9/J5). ``pairs`` is ``{name: (actual_col, predicted_col)}``; output
    columns ``actual_<name>``, ``predicted_<name>``."""
    k = _keys(keys)
    a = actual.select(*k, *[F.col(v[0]).alias(f"actual_{n}") for n, v in pairs.items()])
    p = predicted.select(*k, *[F.col(v[1]).alias(f"predicted_{n}") for n, v in pairs.items()])
    return a.join(p, k, "inner")


def positional_join(a: DataFrame, b: DataFrame, series, ts_a: str, ts_b: str,
                    chunk_us: int | None = None) -> DataFrame:
    """Pair the i-th row of ``a`` with the i-th row of ``b`` per series (J5,
    positional form), using chunked per-series row numbers on both sides."""
    s = _keys(series)
    ra = row_index(a, s, [ts_a], chunk_of(ts_a, chunk_us), "_pos")
    rb = row_index(b, s, [ts_b], chunk_of(ts_b, chunk_us), "_pos")
    return ra.join(rb, [*s, "_pos"], "inner")


def forecast_metrics(df: DataFrame, targets, by=None, huber_delta: float = 1.0) -> DataFrame:
    """MSE (the loss), MAE, Huber and cosine similarity of predictions (M8).

    ``targets`` names columns ``actual_<t>`` / ``predicted_<t>``. Errors are
    averaged over rows and targets; the cosine is taken across the targets of
    each row (0 when a norm is 0) and averaged over rows. ``n`` = rows.
    """
    k = _keys(by)
    errs = [F.col(f"predicted_{t}") - F.col(f"actual_{t}") for t in targets]
    nt = float(len(targets))
    sq = sum((e * e for e in errs), F.lit(0.0)) / nt
    ab = sum((F.abs(e) for e in errs), F.lit(0.0)) / nt
    hub = sum((F.when(F.abs(e) <= huber_delta, 0.5 * e * e)
               .otherwise(huber_delta * (F.abs(e) - 0.5 * huber_delta)) for e in errs), F.lit(0.0)) / nt
    dot = sum((F.col(f"actual_{t}") * F.col(f"predicted_{t}") for t in targets), F.lit(0.0))
    na = F.sqrt(sum((F.col(f"actual_{t}") * F.col(f"actual_{t}") for t in targets), F.lit(0.0)))
    npd = F.sqrt(sum((F.col(f"predicted_{t}") * F.col(f"predicted_{t}") for t in targets), F.lit(0.0)))
    cos = F.when((na == 0) | (npd == 0), F.lit(0.0)).otherwise(dot / (na * npd))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(sq).alias("loss"), F.avg(ab).alias("mae"),
            F.avg(hub).alias("huber"), F.avg(cos).alias("cos")]
    return df.groupBy(*k).agg(*aggs) if k else df.agg(*aggs)


def fedavg_metrics(evals: DataFrame, by="round", n: str = "n", metrics=("cos", "mae"),
                   loss: str = "loss") -> DataFrame:
    """Sample-weighted mean of client metrics per round.

    loss = sum(loss*n)/sum(n) (null when sum(n) = 0); other metrics the same
    but 0 when sum(n) = 0; a round with no rows has no output row.
    """
    k = _keys(by)
    tot = F.sum(n)
    aggs = [F.count(F.lit(1)).alias("clients"), tot.alias("n"),
            F.try_divide(F.sum(F.col(loss) * F.col(n)), tot).alias(loss)]
    aggs += [F.when(tot != 0, F.sum(F.col(m) * F.col(n)) / tot).otherwise(F.lit(0.0)).alias(m) for m in metrics]
    return evals.groupBy(*k).agg(*aggs)
