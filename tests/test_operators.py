"""Unit tests on literal frames (FIXTURES.md part D) and properties."""

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from cadence.operators import clean, evaluate, features, scale, select, sequence, series, split

from conftest import rows

T0 = dt.datetime(2024, 1, 1)


def ts(sec):
    return T0 + dt.timedelta(seconds=sec)


# --------------------------------------------------------------------------- scaling

def test_scaler_defaults_and_inverse(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 5.0), ("b", 5.0), ("b", 5.0)],
                               "sid string, x double")
    p = {r["sid"]: r for r in scale.fit_scaler(df, "sid", ["x"]).collect()}
    assert p["a"]["std"] == pytest.approx(1.527525, abs=1e-6)
    assert p["b"]["std"] == 0.0 and p["a"]["with_mean"] is False
    scaled = scale.apply_scaler(df, scale.fit_scaler(df, "sid", ["x"]), "sid", ["x"])
    assert {r["x"] for r in scaled.filter("sid = 'b'").collect()} == {0.0}
    assert sorted(r["x"] for r in scaled.filter("sid = 'a'").collect()) == pytest.approx(
        [1 / 1.5275252, 2 / 1.5275252, 4 / 1.5275252], rel=1e-6)
    for with_mean in (False, True):
        params = scale.fit_scaler(df, "sid", ["x"], with_mean=with_mean)
        back = scale.inverse_scaler(scale.apply_scaler(df, params, "sid", ["x"]), params, "sid", {"x": "x"})
        got = sorted(r["x"] for r in back.filter("sid = 'a'").collect())
        assert got == pytest.approx([1.0, 2.0, 4.0])


def test_global_scaler_without_series(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    p = scale.fit_scaler(df, None, ["x"], with_mean=True)
    out = sorted(r["x"] for r in scale.apply_scaler(df, p, None, ["x"]).collect())
    assert out == pytest.approx([-1 / math.sqrt(2), 1 / math.sqrt(2)])


# --------------------------------------------------------------------------- grid + interpolation

def test_grid_and_time_interpolation(spark):
    df = spark.createDataFrame([(1, ts(0), 0.0), (1, ts(4), 8.0), (1, ts(6), 9.0)],
                               "sid int, ts timestamp, v double")
    g = series.regular_grid(df, "sid", "ts", 1, checkpoint=False)
    assert g.count() == 7  # (last - first) / step + 1
    out = series.interpolate_time(g, "sid", "ts", ["v"], checkpoint=False).orderBy("ts")
    assert [r["v"] for r in out.collect()] == pytest.approx([0, 2, 4, 6, 8, 8.5, 9])


def test_grid_drops_off_anchor_rows_and_fills_long_gaps(spark):
    df = spark.createDataFrame([(1, ts(0), 1.0), (1, ts(3), 5.0), (1, ts(10), 2.0)],
                               "sid int, ts timestamp, v double")
    g = series.regular_grid(df, "sid", "ts", 2, piece=2, checkpoint=False).orderBy("ts")
    got = rows(g, "ts", "v")
    assert [t for t, _ in got] == [ts(s) for s in (0, 2, 4, 6, 8, 10)]  # 3 s is off the grid
    assert got[0][1] == 1.0 and got[-1][1] == 2.0 and all(v is None for _, v in got[1:-1])


def test_interpolation_leading_and_trailing_nulls(spark):
    df = spark.createDataFrame([(1, ts(0), None), (1, ts(1), 1.0), (1, ts(2), None), (1, ts(3), 3.0),
                                (1, ts(4), None)], "sid int, ts timestamp, v double")
    out = series.interpolate_time(df, "sid", "ts", ["v"], checkpoint=False).orderBy("ts")
    assert [r["v"] for r in out.collect()] == [None, 1.0, 2.0, 3.0, 3.0]


def test_rolling_mean_needs_full_window(spark):
    df = spark.createDataFrame([(1, ts(i * 60), float(i) if i != 5 else None) for i in range(8)],
                               "sid int, ts timestamp, v double")
    out = series.rolling_mean_full(df, "sid", "ts", "v", 3).orderBy("ts")
    got = [r["v_rolling"] for r in out.collect()]
    assert got == [None, None, 1.0, 2.0, 3.0, None, None, None]


def test_rolling_forecast_is_mean_of_previous(spark):
    df = spark.createDataFrame([(1, ts(i), float(i)) for i in range(10)], "sid int, ts timestamp, v double")
    out = series.rolling_forecast(df, "sid", "ts", ["v"], n=3).orderBy("ts")
    got = rows(out, "actual_v", "predicted_v")
    assert got[0] == (1.0, 0.0) and got[1] == (2.0, 0.5) and got[-1] == (9.0, 7.0)


def test_histogram_counts_and_closed_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "v double")
    h = series.histogram(df, "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 2, 2, 2, 3]
    assert h[0]["lo"] == 0.0 and h[-1]["hi"] == 10.0


def test_kde_integrates_to_one(spark):
    df = spark.createDataFrame([(float(v % 17) + (v % 3) * 0.5,) for v in range(400)], "v double")
    k = series.kde(df, "v", points=200).orderBy("point").collect()
    dx = k[1]["x"] - k[0]["x"]
    assert sum(r["density"] for r in k) * dx == pytest.approx(1.0, abs=0.1)


@pytest.mark.parametrize("values", [[1.5, 2.25, 9.0, 9.0, -40.0], [float(i * i % 97) for i in range(300)] + [1000.0]])
def test_kde_equals_the_sum_over_all_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    h = statistics.stdev(values) * len(values) ** -0.2
    for r in series.kde(df, "v", points=33).collect():
        exact = sum(math.exp(-0.5 * ((r["x"] - v) / h) ** 2) for v in values) / (len(values) * h * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(exact, rel=1e-12, abs=1e-300)


def test_kde_without_spread(spark):
    for values in ([], [(3.0,)], [(3.0,), (3.0,)]):
        got = series.kde(spark.createDataFrame(values, "v double"), "v", points=4).collect()
        assert len(got) == (4 if values else 0) and all(r["density"] is None for r in got)


def test_gap_stats(spark):
    df = spark.createDataFrame([(1, ts(0)), (1, ts(10)), (1, ts(30)), (2, ts(5))], "sid int, ts timestamp")
    d = series.time_diffs(df, "sid", "ts")
    g = {r["sid"]: r for r in series.gap_stats(d, "sid").collect()}
    assert g[1]["n_gaps"] == 2 and g[1]["mean_gap"] == 15.0 and g[1]["var_gap"] == 50.0
    assert 2 not in g


def test_weekly_mean_fills_empty_weeks(spark):
    df = spark.createDataFrame([("p", dt.datetime(2024, 1, 2), 1.0), ("p", dt.datetime(2024, 1, 7), 3.0),
                                ("p", dt.datetime(2024, 1, 22), 5.0)], "k string, ts timestamp, v double")
    out = rows(series.weekly_mean(df, "k", "ts", ["v"]).orderBy("ts"), "ts", "v")
    assert out == [(dt.datetime(2024, 1, 7), 2.0), (dt.datetime(2024, 1, 14), None),
                   (dt.datetime(2024, 1, 21), None), (dt.datetime(2024, 1, 28), 5.0)]


def test_date_grid_parallel(spark):
    g = series.date_grid(spark, dt.datetime(2023, 1, 6), dt.datetime(2023, 1, 6, 0, 0, 9), 1, shift_steps=-1,
                         rows_per_partition=3)
    assert g.count() == 10 and g.rdd.getNumPartitions() == 4
    assert g.agg(F.min("ts")).first()[0].replace(tzinfo=None) == dt.datetime(2023, 1, 5, 23, 59, 59)


# --------------------------------------------------------------------------- sequences

def _series_rows(spark, n, null_at=None):
    data = [(1, ts(i * 60), float(i) if i != null_at else None, float(10 * i)) for i in range(n)]
    return spark.createDataFrame(data, "sid int, ts timestamp, x double, y double")


def test_window_keeps_null_in_place(spark):
    df = _series_rows(spark, 14, null_at=3)
    out = sequence.future_sequences(df, "sid", "ts", ["x"], ["y"], 7, 7).collect()
    assert len(out) == 1
    assert out[0]["x_seq"] == [0.0, 1.0, 2.0, None, 4.0, 5.0, 6.0]
    assert out[0]["y_target"] == [70.0, 80.0, 90.0, 100.0, 110.0, 120.0, 130.0]
    assert sequence.future_sequences(df, "sid", "ts", ["x"], ["y"], drop_null_windows=True).count() == 0


def test_short_series_has_no_future_window(spark):
    assert sequence.future_sequences(_series_rows(spark, 13), "sid", "ts", ["x"], ["y"]).count() == 0


@pytest.mark.parametrize("n", [14, 20, 57])
def test_window_count_across_blocks(spark, n):
    df = _series_rows(spark, n)
    out = sequence.future_sequences(df, "sid", "ts", ["x"], ["y"], 7, 7, block=13)
    assert out.count() == max(0, n - 13)
    firsts = sorted(r["x_seq"][0] for r in out.collect())
    assert firsts == [float(i) for i in range(n - 13)]
    same = sequence.same_sequences(df, "sid", "ts", ["x"], ["y"], 7, block=7)
    assert same.count() == n - 6


def test_stack_and_first(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert sequence.stack_steps(df, ["a", "b"]).first()["x"] == [[1.0, 3.0], [2.0, 4.0]]
    assert sequence.first_of_sequence(df, ["a"]).first()["a_first"] == 1.0


# --------------------------------------------------------------------------- splits

def test_time_holdout_dates(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d, 12),) for d in range(1, 21)], "ts timestamp")
    out = split.time_holdout(df, "ts", days=7)
    got = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 12, "test": 8}
    assert out.filter("split = 'test'").agg(F.min("date")).first()[0] == dt.date(2024, 1, 13)


def test_tail_holdout_and_shards_partition_rows(spark):
    df = spark.createDataFrame([(1, ts(i)) for i in range(11)] + [(2, ts(i)) for i in range(5)],
                               "sid int, ts timestamp")
    th = split.tail_holdout(df, "sid", "ts", 0.2)
    got = {(r["sid"], r["split"]): r["n"] for r in th.groupBy("sid", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, "train"): 8, (1, "val"): 3, (2, "train"): 4, (2, "val"): 1}
    sh = split.shards(df, "sid", "ts", 3).filter("sid = 1").orderBy("ts")
    assert [r["shard"] for r in sh.collect()] == [1] * 4 + [2] * 4 + [3] * 3
    sh2 = split.shards(df, "sid", "ts", 7).filter("sid = 2").orderBy("ts")
    assert [r["shard"] for r in sh2.collect()] == [1, 2, 3, 4, 5]
    ln = split.last_n(df, "sid", "ts", 3, skip=1).filter("sid = 1").orderBy("ts")
    assert [r["ts"] for r in ln.collect()] == [ts(7), ts(8), ts(9)]


def test_time_cut_keeps_boundary_row(spark):
    df = spark.createDataFrame([(ts(0),), (ts(1),), (ts(2),)], "ts timestamp")
    out = split.time_cut(df, "ts", ts(1))
    assert sorted(r["split"] for r in out.collect()) == ["train", "val", "val"]


# --------------------------------------------------------------------------- selection / reshape / cleaning

def test_top_series_ties_by_id(spark):
    df = spark.createDataFrame([(3,), (3,), (1,), (1,), (2,)], "sid int")
    assert [r["sid"] for r in select.top_series(df, "sid", 2).collect()] == [1, 3]
    assert select.busiest(df, "sid", 1).count() == 2


def test_seeded_order_and_sample_are_deterministic(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = [r["k"] for r in select.seeded_shuffle(df, ["k"], 42).collect()]
    b = [r["k"] for r in select.seeded_shuffle(df, ["k"], 42).collect()]
    assert a == b and sorted(a) == list(range(1000)) and a != list(range(1000))
    n = select.sample_fraction(df, ["k"], 0.3, 42).count()
    assert 200 < n < 400


def test_melt_drops_zero_keeps_null(spark):
    df = spark.createDataFrame([("f", 0, 2, None)], "id string, m1 int, m2 int, m3 int")
    out = features.melt_nonzero(df, ["id"], ["m1", "m2", "m3"])
    assert sorted(rows(out, "minute", "invocations"), key=str) == [("m2", 2), ("m3", None)]


def test_one_hot_names_and_nulls(spark):
    df = spark.createDataFrame([("0.3.4",), ("1.0",), (None,)], "v string")
    out = features.one_hot(df, "v", "e_vers_")
    assert out.columns == ["v", "e_vers_0_3_4", "e_vers_1_0"]
    assert rows(out, "e_vers_0_3_4", "e_vers_1_0") == [(1, 0), (0, 1), (0, 0)]


def test_stage_durations_sum_to_total(spark):
    t = spark.createDataFrame([("t", 100, 130, 160, 200, 290, 300)],
                              "task_uuid string, received long, waiting_for_nodes long, waiting_for_launch long, "
                              "execution_start long, execution_end long, result_received long")
    r = clean.stage_durations(t).first()
    parts = ["assignment_time", "scheduling_time", "queue_time", "execution_time", "results_time"]
    assert sum(r[p] for p in parts) == r["total_execution_time"] == 200
    assert r["system_processing_time"] == 30 + 40 + 90


# --------------------------------------------------------------------------- evaluation

def test_weighted_metrics(spark):
    ev = spark.createDataFrame([(1, 1, 1.0, 0.5, 2.0), (1, 3, 5.0, 1.0, 4.0)],
                               "round int, n long, loss double, cos double, mae double")
    r = evaluate.fedavg_metrics(ev).first()
    assert r["loss"] == 4.0 and r["cos"] == pytest.approx(0.875) and r["mae"] == 3.5
    assert evaluate.fedavg_metrics(ev.filter("false")).count() == 0
    zero = spark.createDataFrame([(1, 0, 1.0, 0.5, 2.0)], "round int, n long, loss double, cos double, mae double")
    z = zero.transform(evaluate.fedavg_metrics).first()
    assert z["cos"] == 0.0 and z["mae"] == 0.0


def test_forecast_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0, 2.0), (0.0, 0.0, 0.0, 0.0)],
                               "actual_a double, predicted_a double, actual_b double, predicted_b double")
    r = evaluate.forecast_metrics(df, ["a", "b"]).first()
    assert r["n"] == 2 and r["loss"] == pytest.approx((0 + 4) / 2 / 2) and r["mae"] == pytest.approx(0.5)
    assert r["huber"] == pytest.approx(((0 + 1.5) / 2 + 0) / 2)
    assert r["cos"] == pytest.approx((1 / math.sqrt(5) + 0.0) / 2)


def test_positional_join_and_xy_split(spark):
    a = spark.createDataFrame([(1, ts(5), "a1"), (1, ts(9), "a2"), (2, ts(1), "b1")], "sid int, ta timestamp, va string")
    b = spark.createDataFrame([(1, ts(0), "p1"), (1, ts(3), "p2"), (2, ts(7), "q1")], "sid int, tb timestamp, vb string")
    got = sorted(rows(evaluate.positional_join(a, b, "sid", "ta", "tb"), "va", "vb"))
    assert got == [("a1", "p1"), ("a2", "p2"), ("b1", "q1")]
    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0, 4.0], [5.0, 6.0])], "sid int, a array<double>, b array<double>, y1 array<double>")
    r = sequence.xy_split(df, ["a", "b"], ["y1"], keep=["sid"]).first()
    assert r["x"] == [[1.0, 3.0], [2.0, 4.0]] and r["y"] == [[5.0], [6.0]]


def test_constant_column_has_exactly_zero_std(spark):
    # merged floating-point variances of equal values can land near 1e-16;
    # the scaler must still see exactly 0 and scale to 0.0
    df = spark.createDataFrame([("s", 1.0 + 0 * i) for i in range(5000)], "sid string, x double").repartition(37)
    p = scale.fit_scaler(df, "sid", ["x"]).first()
    assert p["std"] == 0.0
    assert {r["x"] for r in scale.apply_scaler(df, scale.fit_scaler(df, "sid", ["x"]), "sid", ["x"]).collect()} == {0.0}
