"""Registered queries over the given test tables.

Each entry is ``f(spark, root) -> DataFrame`` and reads whole tables (no id
subsets, no row caps). Test-table stand-ins: ``events`` is the per-series
stream (series = ``user_id``, tiebreak ``event_id``); ``lineitem ⋈ orders``
are the tasks, ``supplier ⋈ nation ⋈ region`` the endpoints, ``part`` the
functions; ``embeddings`` carry per-client weights and evaluations; metric
samples are derived from ``events ⋈ customer ⋈ nation``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators import clean as C
from cadence.operators import features as FE
from cadence.operators import select as SE
from cadence.operators import split as SP
from cadence.operators import scale as SC
from cadence.operators import sequence as SQ
from cadence.operators import evaluate as EV
from cadence.operators import federated as FD
from cadence.operators import forecast as FC
from cadence.operators import metrics as MT
from cadence.operators import series as SR
from cadence.operators.blocks import materialize, row_index
from cadence.functions.labels import label
from cadence.functions.time import parse_hour_string, parse_iso_offset, parse_wall_clock, second_string
from cadence import streaming as STR
from cadence.plans.report import report
from cadence.plans.training import INPUTS, TARGETS, event_features, training_windows
from cadence.sources import standins as ST
from cadence.sources.sinks import append_gauges, write_table
from cadence.sources import schemas
from cadence.sources.tables import load, read_csv_checked
from cadence.sources.versions import bucketed_join, publish, published, write_bucketed
from cadence.session import written_path

# The per-series operators cut series by counted rows (blocks.ranged), so the
# same queries hold when a series is 1000x longer.


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.root, name)


# --------------------------------------------------------------------------- flagship

def q_training_windows(spark, root):
    t = Tables(spark, root)
    feats = event_features(t.events, "hour")
    return report(training_windows(feats, "user_id", "ts", INPUTS, TARGETS, k=10, holdout_days=7,
                                   L=7, H=7))


# --------------------------------------------------------------------------- cleaning

def _clean(t: Tables, *categories) -> DataFrame:
    tasks = ST.tasks_from_orders(t.lineitem, t.orders)
    endpoints = ST.endpoints_from_suppliers(t.supplier, t.nation, t.region)
    functions = ST.functions_from_parts(t.part)
    return C.clean_tasks(tasks, endpoints, functions, *categories)


def q_star_clean(spark, root):
    return report(_clean(Tables(spark, root)))


def q_stage_durations(spark, root):
    t = Tables(spark, root)
    return report(C.stage_durations(ST.tasks_from_orders(t.lineitem, t.orders)))


def q_task_features(spark, root):
    t = Tables(spark, root)
    d = _clean(t)
    d = C.drop_prefixed(d.drop("task_uuid", "function_uuid"), "e_vers")
    d = d.withColumn("system_processing_time", F.col("scheduling_time") + F.col("queue_time") + F.col("execution_time"))
    types = [c for c in d.columns if c.startswith("e_type_")]
    f = FE.workload_features(d, "endpoint_uuid", "timestamp", "hour", count_as="invocations",
                             means=["loc", "cyc_complexity", "num_of_imports", "argument_size",
                                    "total_execution_time", "system_processing_time"], keep=types)
    f = f.select(*[c for c in f.columns if c not in ("avg_total_execution_time", "avg_system_processing_time")],
                 (F.col("avg_total_execution_time") / 1e9).alias("avg_total_execution_s"),
                 (F.col("avg_system_processing_time") / 1e9).alias("avg_system_processing_s"))
    return report(f)


# --------------------------------------------------------------------------- features / reshape

def q_workload_features(spark, root):
    return report(event_features(Tables(spark, root).events, "hour"))


def q_top_series(spark, root):
    return report(SE.busiest(Tables(spark, root).events, "user_id", 10))


def q_one_hot_type(spark, root):
    return report(FE.one_hot(Tables(spark, root).events, "event_type", "e_type_"))


def q_distinct_values(spark, root):
    return FE.distinct_rows(Tables(spark, root).events, ["event_type"])


def q_melt_nonzero(spark, root):
    e = Tables(spark, root).events.withColumn("h", F.hour("ts"))
    hours = [f"h{h:02d}" for h in range(24)]
    func = e.groupBy("user_id", "event_type").agg(*[F.count_if(F.col("h") == h).alias(n)
                                                     for h, n in enumerate(hours)])
    dur = e.groupBy("user_id", "event_type").agg(F.avg("value").alias("AverageDuration"),
                                                 F.count(F.lit(1)).alias("CountForDuration"))
    mem = e.groupBy("user_id").agg(F.avg("value").alias("AverageAllocatedMb"),
                                   F.count(F.lit(1)).alias("CountForMemory"))
    wide = dur.join(mem, ["user_id"]).join(func, ["user_id", "event_type"])
    ids = ["user_id", "event_type", "AverageDuration", "CountForDuration", "AverageAllocatedMb", "CountForMemory"]
    return report(FE.melt_nonzero(wide, ids, hours, "minute", "invocations"))


def q_melt_chain(spark, root):
    """The second data set end to end: durations, memory and minute counts of the
    applications, joined many to many, melted and one-hot encoded."""
    e = Tables(spark, root).events.select(
        F.pmod("user_id", F.lit(7)).cast("string").alias("HashOwner"), F.col("user_id").cast("string").alias("HashApp"),
        F.col("event_type").alias("HashFunction"), F.hour("ts").alias("h"), "value")
    keys, hours = ["HashOwner", "HashApp"], [f"h{h:02d}" for h in range(24)]
    dur = e.groupBy(*keys, "HashFunction").agg(F.avg("value").alias("AverageDuration"), F.count(F.lit(1)).alias("CountForDuration"))
    mem = e.groupBy(*keys).agg(F.avg("value").alias("AverageAllocatedMb"), F.count(F.lit(1)).alias("CountForMemory"))
    func = e.groupBy(*keys, "HashFunction").agg(*[F.count_if(F.col("h") == h).alias(n) for h, n in enumerate(hours)])
    return report(C.clean_minutes(dur, mem, func.withColumn("Trigger", F.col("HashFunction")), keys, "HashFunction", "Trigger", hours))


def q_seeded_shuffle(spark, root):
    return report(SE.seeded_shuffle(Tables(spark, root).events, ["event_id"], 42))


def q_sample_fraction(spark, root):
    return report(SE.sample_fraction(Tables(spark, root).events, ["event_id"], 0.3, 42))


# --------------------------------------------------------------------------- splits

def _ev(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "ts", "value")


def q_time_holdout(spark, root):
    return report(SP.time_holdout(_ev(Tables(spark, root)), "ts", series="user_id", days=7))


def q_time_holdout_global(spark, root):
    return report(SP.time_holdout(_ev(Tables(spark, root)), "ts", series=None, days=7))


def q_tail_holdout(spark, root):
    return report(SP.tail_holdout(_ev(Tables(spark, root)), "user_id", "ts", 0.2, tiebreak="event_id"))


def q_shards(spark, root):
    return report(SP.shards(_ev(Tables(spark, root)), "user_id", "ts", 3, tiebreak="event_id"))


def q_shards_global(spark, root):
    """Shards of the whole stream, written by shard and read back."""
    from cadence.session import written_path
    path = written_path(spark, "shards")
    write_table(SP.shards_global(_ev(Tables(spark, root)), "ts", 7, tiebreak="event_id"), path, ["shard"])
    return report(spark.read.parquet(path))


def q_last_n(spark, root):
    return report(SP.last_n(_ev(Tables(spark, root)), "user_id", "ts", 5, skip=2, tiebreak="event_id"))


def q_concat_splits(spark, root):
    h = SP.time_holdout(_ev(Tables(spark, root)), "ts", series="user_id", days=7)
    return report(SE.concat(h.filter("split = 'train'"), h.filter("split = 'test'")))


# --------------------------------------------------------------------------- scaling

SCALE_COLS = ["invocations", "avg_value", "max_value", "sum_value"]


def _hourly(t: Tables) -> DataFrame:
    return event_features(t.events, "hour")


def q_scale_fit(spark, root):
    return report(SC.fit_scaler(_hourly(Tables(spark, root)), "user_id", SCALE_COLS))


def q_scale_apply(spark, root):
    f = _hourly(Tables(spark, root))
    return report(SC.apply_scaler(f, SC.fit_scaler(f, "user_id", SCALE_COLS), "user_id", SCALE_COLS))


def q_publish_chain(spark, root):
    """Features split in time, scaler fitted on train rows, all three published as one
    version, read back and scaled."""
    f = SP.time_holdout(_hourly(Tables(spark, root)), "ts", series="user_id", days=7).drop("date")
    f = materialize(f)
    at = written_path(spark, "published")
    train = f.where("split = 'train'")
    publish(spark, {"train": train, "test": f.where("split = 'test'"),
                    "params": SC.fit_scaler(train, "user_id", SCALE_COLS)}, at)
    t = published(spark, at, ["train", "test", "params"])
    back = t["train"].unionByName(t["test"])
    return report(SC.apply_scaler(back, t["params"], "user_id", SCALE_COLS).select("user_id", "ts", "split", *SCALE_COLS))


def q_bucketed_features(spark, root):
    """Hourly features and the errors of each hour, two tables bucketed alike and joined
    without a shuffle."""
    t, keys = Tables(spark, root), ["user_id", "ts"]
    errors = (t.events.where("event_type = 'error'").groupBy("user_id", F.date_trunc("hour", "ts").alias("ts"))
              .agg(F.count(F.lit(1)).alias("errors"), F.max("value").alias("worst")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    f, e = (write_bucketed(d, written_path(spark, "bucketed"), keys, n) for d in (_hourly(t), errors))
    return report(bucketed_join(f.select(*keys, "invocations", "avg_value"), e, keys, "left").fillna(0, ["errors"]))


def q_csv_read_back(spark, root):
    """Events as CSV files, read back with their types; lines that don't fit would be marked."""
    at = written_path(spark, "csv")
    write_table(Tables(spark, root).events.select(schemas.EVENTS.fieldNames())
                .withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")), at, fmt="csv")
    back = read_csv_checked(spark, at, schemas.EVENTS)
    return report(back.withColumn("bad", F.col("_bad_line").isNotNull()).drop("_bad_line"))


def q_scale_inverse(spark, root):
    f = _hourly(Tables(spark, root))
    p = SC.fit_scaler(f, "user_id", SCALE_COLS, with_mean=True)
    back = SC.inverse_scaler(SC.apply_scaler(f, p, "user_id", SCALE_COLS), p, "user_id",
                             {c: c for c in SCALE_COLS})
    return report(back)


# --------------------------------------------------------------------------- sequences

def _daily(t: Tables) -> DataFrame:
    return event_features(t.events, "day")


def q_sequences_future(spark, root):
    return report(SQ.future_sequences(_daily(Tables(spark, root)), "user_id", "ts", INPUTS, TARGETS, 7, 7))


def _same(spark, root):
    return SQ.same_sequences(_daily(Tables(spark, root)), "user_id", "ts", INPUTS, TARGETS, 7)


def q_sequences_same(spark, root):
    return report(_same(spark, root))


def q_first_of_sequence(spark, root):
    s = SQ.first_of_sequence(_same(spark, root), ["ts_seq", "max_value_target", "sum_value_target"])
    return report(s.select("user_id", "ts_seq_first", "max_value_target_first", "sum_value_target_first"))


def q_xy_matrices(spark, root):
    """Windows as one matrix of inputs and one of targets."""
    return report(SQ.xy_split(_same(spark, root), ["invocations_seq", "avg_value_seq"], ["max_value_target", "sum_value_target"],
                              keep=["user_id", "ts_seq"]))


def q_stack_steps(spark, root):
    s = SQ.stack_steps(_same(spark, root), ["invocations_seq", "avg_value_seq"], "x")
    return report(s.select("user_id", "ts_seq", "x"))



# --------------------------------------------------------------------------- series

GRID_COLS = ["invocations", "avg_value", "max_value", "sum_value"]


def _grid(spark, root):
    return SR.regular_grid(_hourly(Tables(spark, root)), "user_id", "ts", 3600)


def q_regular_grid(spark, root):
    return report(_grid(spark, root))


def q_interpolate_time(spark, root):
    g = _grid(spark, root)
    return report(SR.interpolate_time(g, "user_id", "ts", GRID_COLS))


def q_date_grid(spark, root):
    e = Tables(spark, root).events
    r = e.agg(F.unix_micros(F.date_trunc("hour", F.min("ts"))).alias("a"),
              F.unix_micros(F.date_trunc("hour", F.max("ts"))).alias("b")).first()
    return report(SR.date_grid(spark, r["a"], r["b"], 3600, shift_steps=-1))


def _gaps(spark, root):
    e = _ev(Tables(spark, root))
    d = SR.time_diffs(e, "user_id", "ts", tiebreak="event_id")
    return d.withColumn("dt_h", F.col("dt") / 3600.0)


def q_time_diffs(spark, root):
    return report(_gaps(spark, root).select("event_id", "user_id", "ts", "dt"))


def q_gap_stats(spark, root):
    g = SR.gap_stats(_gaps(spark, root), "user_id", "dt_h")
    return report(g.select("user_id", "n_gaps", F.col("mean_gap").alias("mean_gap_h"),
                           F.col("var_gap").alias("var_gap_h2")))


def q_gap_histogram(spark, root):
    return report(SR.histogram(_gaps(spark, root), "dt_h", 50))


def q_kde(spark, root):
    return report(SR.kde(Tables(spark, root).events, "value", points=64))


def _weekly(spark, root):
    o = Tables(spark, root).orders
    return SR.weekly_mean(o, "o_orderpriority", "o_orderdate", ["o_totalprice"])


def q_weekly_mean(spark, root):
    return report(_weekly(spark, root))


def q_rolling_mean_full(spark, root):
    r = SR.rolling_mean_full(_weekly(spark, root), "o_orderpriority", "o_orderdate", "o_totalprice", 56)
    return report(r)


def _rolling(spark, root):
    return SR.rolling_forecast(_daily(Tables(spark, root)), "user_id", "ts", TARGETS, n=7)


def q_rolling_forecast(spark, root):
    return report(_rolling(spark, root))


def q_forecast_metrics(spark, root):
    return report(EV.forecast_metrics(_rolling(spark, root), TARGETS, by="user_id"))


# --------------------------------------------------------------------------- federated

def q_fedavg_weights(spark, root):
    w = ST.client_weights_from_embeddings(Tables(spark, root).embeddings)
    return report(FD.fedavg_weights(w, by=["round", "layer"]))


FED_X = ["invocations", "avg_value"]
FED_SHAPE = (len(FED_X) + 1, len(TARGETS))
FED_ROUNDS, FED_EPOCHS = 20, 5


def _fed_split(spark, root):
    """Hourly rows of every client, scaled on its train rows; a client without train rows has no scale and no part."""
    cols = FED_X + TARGETS
    raw = materialize(SP.time_holdout(_hourly(Tables(spark, root)), "ts", series="user_id", days=7).drop("date"))
    p = SC.fit_scaler(raw.filter("split = 'train'"), "user_id", cols, with_mean=True)
    return materialize(SC.apply_scaler(raw, p, "user_id", cols).dropna(subset=cols))


def _fed_maps(split):
    """Local fits by profile: batch size and learning rate of the client's profile, several epochs."""
    train = FD.assign_profiles(split.filter("split = 'train'"), "user_id")
    b = FD.batch_grams(train, "user_id", FED_X, TARGETS, "ts", "batch_size")
    return FD.local_maps(FD.assign_profiles(b, "user_id"), "user_id", "learning_rate", FED_EPOCHS)


def _flat_weights(df):
    """One array of weights, without what is rounding noise beside weights of about 1."""
    return df.withColumn("weights", F.transform(F.flatten("weights"), lambda w: F.round(w, 12)))


def _fed_history(spark, root, server=FD.averaged):
    split = _fed_split(spark, root)
    h = materialize(FD.fed_rounds(_fed_maps(split), FED_SHAPE, FED_ROUNDS, server))
    return h, FD.evaluate_rounds(split.filter("split = 'test'"), "user_id", FED_X, TARGETS, h)


def _evals(spark, root):
    """Every client's evaluation of every round: what a server aggregates, gauges and streams."""
    e = _fed_history(spark, root)[1]
    return e.select("round", F.col("user_id").alias("client"), "n", "loss", "cos", "mae")


def q_fedavg_metrics(spark, root):
    return report(EV.fedavg_metrics(_evals(spark, root), by="round"))


def q_gauge_latest(spark, root):
    m = EV.fedavg_metrics(_evals(spark, root), by="round")
    g = MT.to_samples(m.withColumn("ts", F.timestamp_seconds(F.col("round").cast("long"))), "ts",
                      {"model_loss": "loss", "model_cosine_similarity": "cos", "model_mean_absolute_error": "mae"})
    path = written_path(spark, "gauges")
    append_gauges(g, path)
    return report(MT.latest(spark.read.schema(schemas.SAMPLES).parquet(path)).select("name", "ts", "value"))


def q_fed_round_one(spark, root):
    """One full-batch step of every client from zero, averaged."""
    d = _daily(Tables(spark, root))
    cols = FED_X + ["max_value"]
    d = SC.apply_scaler(d, SC.fit_scaler(d, "user_id", cols, with_mean=True), "user_id", cols)
    maps = FD.local_maps(FD.batch_grams(d, "user_id", FED_X, "max_value"), "user_id", 0.1)
    return report(_flat_weights(FD.fed_rounds(maps, (3, 1), 1)).select("round", "weights", "n"))


def q_fed_local_fit(spark, root):
    """Each client's weights after its first local fit (mini-batches, epochs) from zero."""
    maps = _fed_maps(_fed_split(spark, root))
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), FED_SHAPE[1]), FED_SHAPE[0])
    return report(_flat_weights(maps.select("user_id", "n", FD.moved(F.col("map"), zero).alias("weights"))))


def _with_metrics(h, evals):
    m = EV.fedavg_metrics(evals, by="round").select("round", "clients", "loss", "cos", "mae")
    return _flat_weights(h).join(m, "round")


def q_fed_rounds(spark, root):
    """History of the rounds: global weights, and the clients' metrics aggregated."""
    return report(_with_metrics(*_fed_history(spark, root)))


def q_fed_momentum(spark, root):
    """The same rounds with a server that keeps momentum."""
    return report(_with_metrics(*_fed_history(spark, root, FD.momentum(0.5))))


def q_fed_trimmed_round(spark, root):
    """One round of the coordinate-wise trimmed mean of the clients' weights."""
    maps = _fed_maps(_fed_split(spark, root))
    return report(_flat_weights(FD.fed_rounds_by(maps, FED_SHAPE, 1, FD.trimmed_mean(0.1))))


def q_fed_evaluate(spark, root):
    """Per client, the last round's weights on its held-out rows."""
    e = _fed_history(spark, root)[1]
    return report(e.where(F.col("round") == FED_ROUNDS).select("user_id", "n", "loss", "mae", "cos"))


def q_client_profiles(spark, root):
    clients = Tables(spark, root).events.select("user_id").distinct()
    return report(FD.assign_profiles(clients, "user_id"))


def q_linear_huber(spark, root):
    return report(FC.linear_huber(_daily(Tables(spark, root)), FED_X, "max_value"))


def q_huber_windows(spark, root):
    """One map of the inputs to both targets over all steps of all windows, Huber loss."""
    d = _daily(Tables(spark, root))
    cols = FED_X + TARGETS
    d = SC.apply_scaler(d, SC.fit_scaler(d, "user_id", cols, with_mean=True), "user_id", cols)
    windows = SQ.same_sequences(d, "user_id", "ts", FED_X, TARGETS, 7)
    fit = FC.huber_map(FC.window_steps(windows, FED_X, TARGETS), FED_X, TARGETS)
    return report(fit.select("target", F.transform("weights", lambda w: F.round(w, 10)).alias("weights"), "loss", "n", "n_left_out"))


# --------------------------------------------------------------------------- ARX forecasting

def _diffs(spark, root, exog):
    return FC.diff_rows(_daily(Tables(spark, root)), "user_id", "ts", "sum_value", exog)


def q_ar1_diff(spark, root):
    g = FC.arx_gram(_diffs(spark, root, []), "user_id", 0)
    return report(FC.fit_arx_diff(g, "user_id", 0, iters=1).select("user_id", "n", "phi"))


def q_sarimax_cls(spark, root):
    g = FC.arx_gram(_diffs(spark, root, ["invocations"]), "user_id", 1)
    p = FC.fit_arx_diff(g, "user_id", 1, iters=1)
    return report(p.select("user_id", "n", "phi", F.element_at("beta", 1).alias("beta")))


def q_ar1_both_targets(spark, root):
    """AR(1) on differences of both targets, ``target`` as a key column."""
    long = FC.targets_long(_daily(Tables(spark, root)), "user_id", "ts", TARGETS)
    rows = FC.diff_rows(long, ["user_id", "target"], "ts", "y")
    g = FC.arx_gram(rows, ["user_id", "target"], 0)
    return report(FC.fit_arx_diff(g, ["user_id", "target"], 0, iters=1).select("user_id", "target", "n", "phi"))


def _daily_grid(spark, root):
    """Daily rows on a regular grid, gaps interpolated: what the forecasts run on."""
    g = SR.regular_grid(_daily(Tables(spark, root)), "user_id", "ts", 86_400)
    return materialize(SR.interpolate_time(g, "user_id", "ts", GRID_COLS))


def q_rolling_forecast_grid(spark, root):
    return report(SR.rolling_forecast(_daily_grid(spark, root), "user_id", "ts", TARGETS, n=7))


ARX_KEYS = ["user_id", "target"]


def q_arx_fit(spark, root):
    """Both targets, two exogenous inputs, exact likelihood."""
    long = FC.targets_long(_daily_grid(spark, root), "user_id", "ts", TARGETS, FED_X)
    rows = materialize(FC.diff_rows(long, ARX_KEYS, "ts", "y", FED_X, first=True))  # read by the fit and the residual pass
    p = FC.fit_arx(FC.arx_moments(rows, ARX_KEYS, 2), ARX_KEYS)
    p = p.select(*ARX_KEYS, "n", "phi", "beta", "sigma2", "loglik")
    return report(p.join(FC.in_sample_mae(rows, p, ARX_KEYS, 2), ARX_KEYS))


def _arx_forecast(spark, root):
    """Forecasts over the last seven days from a fit on the days before, with the future inputs; and the rows of those days."""
    d = SP.time_holdout(_daily_grid(spark, root), "ts", series="user_id", days=7).drop("date")
    long = materialize(FC.targets_long(d, "user_id", "ts", TARGETS, [*FED_X, "split"]))
    train, test = long.filter("split = 'train'"), long.filter("split = 'test'")
    rows = materialize(FC.diff_rows(train, ARX_KEYS, "ts", "y", FED_X, first=True))
    p = FC.fit_arx(FC.arx_moments(rows, ARX_KEYS, 2), ARX_KEYS)
    future = materialize(row_index(test, ARX_KEYS, ["ts"], name="h"))
    fc = FC.forecast_arx_diff(p, FC.last_state(rows, ARX_KEYS, "ts", 2), future.select(*ARX_KEYS, "h", *FED_X), ARX_KEYS, FED_X)
    return fc.select(*ARX_KEYS, "h", "forecast"), future


def q_arx_forecast(spark, root):
    fc, future = _arx_forecast(spark, root)
    return report(future.select(*ARX_KEYS, "h", "ts", F.col("y").alias("actual")).join(fc, [*ARX_KEYS, "h"]))


def q_prediction_table(spark, root):
    """Forecasts of both targets beside the rows that they are for, paired by position:
    the i-th forecast step with the i-th row of the series, though the forecasts reach
    two steps less far."""
    fc, future = _arx_forecast(spark, root)
    wide = fc.where("h <= 6").groupBy("user_id", "h").agg(
        *[F.max(F.when(F.col("target") == t, F.col("forecast"))).alias(f"predicted_{t}") for t in TARGETS])
    rows = future.groupBy("user_id", "ts").agg(*[F.max(F.when(F.col("target") == t, F.col("y"))).alias(f"actual_{t}") for t in TARGETS])
    j = EV.positional_join(rows, wide, "user_id", "ts", "h")
    return report(j.select("user_id", "ts", *[f"{k}_{t}" for t in TARGETS for k in ("actual", "predicted")]))


# --------------------------------------------------------------------------- metric queries

RATE_RANGE_S, RATE_STEP_S = 86_400, 3_600
NOW = "2024-01-15 12:00:00"


def _samples(spark, root, *metrics):
    t = Tables(spark, root)
    return ST.samples_from_events(t.events, t.customer, t.nation, metrics or ST.METRICS)


def _label_sets(spark, root):
    t = Tables(spark, root)
    return ST.series_from_events(t.events, t.customer, t.nation)


def _flat(df, value="value"):
    return df.select("name", label("instance").alias("instance"), label("name").alias("container"),
                     label("id").alias("id"), "ts", value)


def q_counter_rate(spark, root):
    s = MT.match_labels(_samples(spark, root, ST.CPU), [], name=ST.CPU)
    return report(_flat(MT.counter_rate(s, RATE_RANGE_S, RATE_STEP_S)))


def q_counter_rate_samples(spark, root):
    s = MT.match_labels(_samples(spark, root, ST.CPU), [], name=ST.CPU)
    return report(_flat(MT.counter_rate_at_samples(s, 6 * 3600)))


SELECTOR = [("instance", "=~", ".*"), ("name", "=~", ".+"), ("name", "!~", "(BUILDING|FURNITURE)")]


def q_cpu_by_name(spark, root):
    s = MT.match_labels(_samples(spark, root, ST.CPU), SELECTOR, name=ST.CPU)
    r = MT.counter_rate(s, RATE_RANGE_S, RATE_STEP_S)
    return report(MT.sum_by(r, "name", scale=100.0))


def q_memory_by_name(spark, root):
    s = MT.match_labels(_samples(spark, root, ST.RSS), SELECTOR, name=ST.RSS)
    v = MT.instant_values(s, RATE_STEP_S, lookback_s=3_600)
    return report(MT.sum_by(v, "name"))


def q_network_by_name(spark, root):
    """Bytes a second received and sent, summed by container name."""
    s = MT.match_labels(_samples(spark, root, ST.RX, ST.TX), SELECTOR)
    r = materialize(MT.counter_rate(s, RATE_RANGE_S, RATE_STEP_S))
    both = [MT.sum_by(r.where(F.col("name") == m), "name").withColumn("direction", F.lit(d))
            for m, d in ((ST.RX, "received"), (ST.TX, "sent"))]
    return report(both[0].unionByName(both[1]))


def q_cache_by_name(spark, root):
    s = MT.match_labels(_samples(spark, root, ST.CACHE), SELECTOR, name=ST.CACHE)
    return report(MT.sum_by(MT.instant_values(s, RATE_STEP_S, lookback_s=3_600), "name"))


def q_label_filter(spark, root):
    s = MT.match_labels(_samples(spark, root, ST.RSS),
                        [("instance", "=~", "NATION_(1|2|3)"), ("name", "!~", "AUTO.*")], name=ST.RSS)
    return report(_flat(s))


def q_label_values(spark, root):
    return MT.label_values(_label_sets(spark, root), "instance", name_regex="container.*")


def q_label_values_dependent(spark, root):
    return MT.label_values(_label_sets(spark, root), "name", name_regex="container.*",
                           matchers=[("instance", "=~", "NATION_1.*")])


def q_instant_info(spark, root):
    at_now = _samples(spark, root, ST.START).filter(F.col("ts") <= F.lit(NOW).cast("timestamp"))
    s = MT.latest(MT.match_labels(at_now, [("name", "=~", ".+")], name=ST.START))
    now_s = spark.sql(f"select unix_seconds(timestamp'{NOW}')").first()[0]
    a = MT.age_days(s, now_s, digits=None)
    return report(MT.info_table(a, {"instance": "host", "name": "container", "id": "id"})
                  .withColumnRenamed("value", "age_days"))


def q_recent(spark, root):
    return report(_flat(MT.recent(_samples(spark, root), NOW, 15)))


# --------------------------------------------------------------------------- streaming

def q_stream_features(spark, root):
    path = f"{root}/events.parquet"
    s = STR.source(spark, path, spark.read.parquet(path).schema)
    return report(STR.run_to_latest(STR.stream_features(s, "user_id", "ts", "1 day", "1 hour"), ["user_id", "window_start"], "features"))


def q_stream_rate(spark, root):
    from cadence.session import written_path
    path = written_path(spark, "samples")
    _samples(spark, root, ST.CPU).write.parquet(path)
    s = STR.source(spark, path, spark.read.parquet(path).schema)
    panes = STR.run_to_latest(STR.stream_panes(s, RATE_STEP_S, "1 hour"), ["name", "sid", "pane"], "panes")
    r = MT.rate_from_panes(panes, RATE_RANGE_S, RATE_STEP_S)
    return report(_flat(r).withColumnRenamed("ts", "window_end"))


def q_stream_gauges(spark, root):
    from cadence.session import written_path
    path = written_path(spark, "evals")
    _evals(spark, root).repartition(4, "client").write.parquet(path)  # a round's evaluations come in several files
    s = STR.source(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    out = STR.stream_gauges(s)
    return report(spark.read.parquet(out).select("name", "ts", "value"))


# --------------------------------------------------------------------------- predictions, cuts, slices

def q_predictions_inverse(spark, root):
    """Forecast on per-user scaled targets, then both actual and predicted
    columns scaled back with the target's parameters (M4, M9)."""
    d = _daily(Tables(spark, root))
    params = SC.fit_scaler(d, "user_id", TARGETS, with_mean=True)
    scaled = SC.apply_scaler(d, params, "user_id", TARGETS)
    pred = SR.rolling_forecast(scaled, "user_id", "ts", TARGETS, n=7)
    mapping = {f"{k}_{t}": t for t in TARGETS for k in ("actual", "predicted")}
    return report(SC.inverse_scaler(pred, params, "user_id", mapping))


def q_time_cut(spark, root):
    return report(SP.time_cut(_ev(Tables(spark, root)), "ts", "2024-01-15 12:00:00"))


def q_time_slice(spark, root):
    o = Tables(spark, root).orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    return report(SP.year_slice(o, "o_orderdate", 1996, 1998))


def q_time_slice_inclusive(spark, root):
    o = Tables(spark, root).orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    return report(SP.time_slice(o, "o_orderdate", "1996-01-01", "1998-12-31"))


def q_time_strings(spark, root):
    """Times written as text in the forms of the logs, and read back from them."""
    e = Tables(spark, root).events
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+02:00"))
    return report(e.select("event_id", second_string("ts").alias("text"), parse_iso_offset(iso).alias("instant"),
                           parse_wall_clock(iso).alias("wall"), parse_hour_string(F.date_format("ts", "yyyy-MM-dd:HH")).alias("hour")))


# --------------------------------------------------------------------------- the task chain end to end

TASK_INPUTS = ["invocations", "avg_argument_size", "avg_loc", "avg_cyc_complexity", "avg_num_of_imports"]
TASK_TARGETS = ["avg_total_execution_time", "avg_system_processing_time"]


def q_task_windows(spark, root):
    """Clean tasks -> per-(endpoint, second) features -> ten busiest endpoints
    -> one-year holdout (as many tasks as a window needs) -> scaler fitted on train -> 7-in / 7-out windows."""
    d = _clean(Tables(spark, root), [], [])
    d = d.withColumn("system_processing_time",
                     F.col("scheduling_time") + F.col("queue_time") + F.col("execution_time"))
    f = FE.workload_features(d, "endpoint_uuid", "timestamp", "second", count_as="invocations",
                             means=["loc", "cyc_complexity", "num_of_imports", "argument_size",
                                    "total_execution_time", "system_processing_time"], out_ts="ts")
    return report(training_windows(f, "endpoint_uuid", "ts", TASK_INPUTS, TASK_TARGETS, k=10,
                                   holdout_days=365, L=7, H=7))


QUERIES = {
    "training_windows": q_training_windows,
    "star_clean": q_star_clean,
    "stage_durations": q_stage_durations,
    "task_features": q_task_features,
    "workload_features": q_workload_features,
    "top_series": q_top_series,
    "one_hot_type": q_one_hot_type,
    "distinct_values": q_distinct_values,
    "melt_nonzero": q_melt_nonzero,
    "melt_chain": q_melt_chain,
    "seeded_shuffle": q_seeded_shuffle,
    "sample_fraction": q_sample_fraction,
    "time_holdout": q_time_holdout,
    "time_holdout_global": q_time_holdout_global,
    "tail_holdout": q_tail_holdout,
    "shards": q_shards,
    "shards_global": q_shards_global,
    "last_n": q_last_n,
    "concat_splits": q_concat_splits,
    "scale_fit": q_scale_fit,
    "scale_apply": q_scale_apply,
    "publish_chain": q_publish_chain,
    "bucketed_features": q_bucketed_features,
    "csv_read_back": q_csv_read_back,
    "scale_inverse": q_scale_inverse,
    "sequences_future": q_sequences_future,
    "sequences_same": q_sequences_same,
    "first_of_sequence": q_first_of_sequence,
    "stack_steps": q_stack_steps,
    "xy_matrices": q_xy_matrices,
    "regular_grid": q_regular_grid,
    "interpolate_time": q_interpolate_time,
    "date_grid": q_date_grid,
    "time_diffs": q_time_diffs,
    "gap_stats": q_gap_stats,
    "gap_histogram": q_gap_histogram,
    "kde": q_kde,
    "weekly_mean": q_weekly_mean,
    "rolling_mean_full": q_rolling_mean_full,
    "rolling_forecast": q_rolling_forecast,
    "forecast_metrics": q_forecast_metrics,
    "fedavg_weights": q_fedavg_weights,
    "fedavg_metrics": q_fedavg_metrics,
    "gauge_latest": q_gauge_latest,
    "fed_round_one": q_fed_round_one,
    "fed_rounds": q_fed_rounds,
    "fed_evaluate": q_fed_evaluate,
    "fed_local_fit": q_fed_local_fit,
    "fed_momentum": q_fed_momentum,
    "fed_trimmed_round": q_fed_trimmed_round,
    "client_profiles": q_client_profiles,
    "linear_huber": q_linear_huber,
    "huber_windows": q_huber_windows,
    "ar1_diff": q_ar1_diff,
    "sarimax_cls": q_sarimax_cls,
    "arx_fit": q_arx_fit,
    "arx_forecast": q_arx_forecast,
    "rolling_forecast_grid": q_rolling_forecast_grid,
    "prediction_table": q_prediction_table,
    "counter_rate": q_counter_rate,
    "cpu_by_name": q_cpu_by_name,
    "memory_by_name": q_memory_by_name,
    "network_by_name": q_network_by_name,
    "cache_by_name": q_cache_by_name,
    "label_filter": q_label_filter,
    "label_values": q_label_values,
    "label_values_dependent": q_label_values_dependent,
    "instant_info": q_instant_info,
    "recent": q_recent,
    "stream_features": q_stream_features,
    "stream_rate": q_stream_rate,
    "stream_gauges": q_stream_gauges,
    "predictions_inverse": q_predictions_inverse,
    "time_cut": q_time_cut,
    "time_slice": q_time_slice,
    "time_slice_inclusive": q_time_slice_inclusive,
    "time_strings": q_time_strings,
    "counter_rate_samples": q_counter_rate_samples,
    "task_windows": q_task_windows,
    "ar1_both_targets": q_ar1_both_targets,
}
