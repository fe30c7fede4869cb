"""Training windows for the busiest series, as one lazy plan.

read -> per-interval features (A1) -> top-k series (L2/J4) -> time holdout
(R3) -> scaler fitted on train rows (M2) -> scaled (M3) -> future windows per
(series, split) (W1-W3). Shuffles: the feature aggregate, the row-index chunk
join and the window blocks; the top-k list and scaler parameters are small
joins (the top-k list is bounded by k and broadcast explicitly). The feature
table and the split rows are checkpointed once because several steps read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.blocks import materialize
from cadence.operators.features import workload_features
from cadence.operators.scale import apply_scaler, fit_scaler
from cadence.operators.select import busiest
from cadence.operators.sequence import future_sequences
from cadence.operators.split import time_holdout

INPUTS = ["invocations", "avg_value"]
TARGETS = ["max_value", "sum_value"]


def event_features(events: DataFrame, unit: str = "day") -> DataFrame:
    """Per-user, per-interval features of the event stream: count and mean
    value as inputs; max and total value as the two targets."""
    return workload_features(events, "user_id", "ts", unit, count_as="invocations", means=["value"],
                             extra={"max_value": F.max("value"), "sum_value": F.sum("value")})


def training_windows(features: DataFrame, series: str, ts: str, inputs, targets, k: int = 10,
                     holdout_days: int = 7, L: int = 7, H: int = 7, fit_on: str = "train",
                     chunk_us: int | None = None, checkpoint: bool = True) -> DataFrame:
    """Scaled ``L``-in / ``H``-out windows of the ``k`` busiest series, with a
    ``split`` column (train/test); windows never cross the split.

    The feature table and the split rows each feed several consumers (top-k
    and rows; max date and rows; scaler fit and rows), so with ``checkpoint``
    they are written once to the shared checkpoint folder instead of being
    recomputed from the raw data by every consumer.
    """
    cols = list(inputs) + list(targets)
    if checkpoint:
        features = materialize(features)
    top = busiest(features, series, k)
    split = time_holdout(top, ts, series=series, days=holdout_days).drop("date")
    if checkpoint:
        split = materialize(split)
    fit_rows = split.filter(F.col("split") == "train") if fit_on == "train" else split
    params = fit_scaler(fit_rows, series, cols)
    scaled = apply_scaler(split, params, series, cols)
    return future_sequences(scaled, [series, "split"], ts, inputs, targets, L, H, chunk_us=chunk_us)
