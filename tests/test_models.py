"""Counter rates, federated averaging, AR(1)-error regression, streaming."""

import datetime as dt
import os
import tempfile
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadence.operators import federated as fd
from cadence.operators import forecast as fc
from cadence.operators import metrics as mt
from cadence import streaming as st

T0 = dt.datetime(2024, 1, 1)


def _samples(spark, values, name="c", labels=None):
    labels = labels or {"name": "app", "instance": "h1"}
    data = [(name, labels, T0 + dt.timedelta(seconds=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "name string, labels map<string,string>, ts timestamp, value double")


def test_counter_rate_with_reset(spark):
    values = [0, 10, 20, 5, 15, 25, 35, 45, 55, 65, 75, 85]
    r = mt.counter_rate(_samples(spark, values), range_s=10, step_s=1)
    got = {row["ts"]: row["value"] for row in r.collect()}
    assert got[T0 + dt.timedelta(seconds=11)] == pytest.approx(85 / 9)
    assert min(got.values()) >= 0
    # fewer than two samples in range: no value at the first instant
    assert T0 not in got


def test_counter_rate_at_sample_times(spark):
    values = [0, 10, 20, 5, 15, 25, 35, 45, 55, 65, 75, 85]
    df = _samples(spark, values)
    r = {row["ts"]: row["value"] for row in mt.counter_rate_at_samples(df, 10, chunk_us=4_000_000).collect()}
    assert r[T0 + dt.timedelta(seconds=11)] == pytest.approx(85 / 9)
    assert r[T0 + dt.timedelta(seconds=1)] == pytest.approx(10.0)
    assert T0 not in r and min(r.values()) >= 0 and len(r) == 11


def test_sum_by_and_label_values(spark):
    a = _samples(spark, [0, 10, 20], labels={"name": "a", "instance": "h1"})
    b = _samples(spark, [0, 5, 10], labels={"name": "b", "instance": "h2"})
    rate = mt.counter_rate(a.unionByName(b), 10, 1)
    s = {(r["ts"], r["name"]): r["value"] for r in mt.sum_by(rate, "name", scale=100.0).collect()}
    assert s[(T0 + dt.timedelta(seconds=2), "a")] == pytest.approx(1000.0)
    vals = sorted(r["instance"] for r in mt.label_values(a.unionByName(b), "instance", name_regex="c.*").collect())
    assert vals == ["h1", "h2"]
    latest = mt.latest(a).first()
    assert latest["value"] == 20.0


def test_fedavg_weights(spark):
    w = spark.createDataFrame([(1, 0, 1, [0.0, 2.0]), (1, 0, 3, [4.0, 6.0])],
                              "round int, layer int, n long, weights array<double>")
    assert fd.fedavg_weights(w).first()["weights"] == [3.0, 5.0]
    same = spark.createDataFrame([(1, 0, 2, [1.5, -2.0]), (1, 0, 7, [1.5, -2.0])],
                                 "round int, layer int, n long, weights array<double>")
    assert fd.fedavg_weights(same).first()["weights"] == pytest.approx([1.5, -2.0])


def _clients(rows_of):
    """A table of clients with two inputs and two targets, in the order of ``t``."""
    rng = np.random.default_rng(3)
    frames = []
    for c, n in enumerate(rows_of):
        x1, x2 = rng.normal(c * 0.2, 1.0, n), rng.normal(0, 1.0, n)
        frames.append(pd.DataFrame({"client": c, "t": range(n), "x1": x1, "x2": x2, "y": 0.5 + 0.8 * x1 - 0.3 * x2 + rng.normal(0, 0.1, n),
                                    "y2": -1.0 + 0.2 * x1 + rng.normal(0, 0.1, n)}))
    return pd.concat(frames)


def _plain_fit(w, g, lr, size, epochs):
    """Mini-batch gradient descent, step by step."""
    X, Y = np.column_stack([np.ones(len(g)), g.x1, g.x2]), g[["y", "y2"]].to_numpy()
    for _ in range(epochs):
        for a in range(0, len(g), size):
            x, y = X[a:a + size], Y[a:a + size]
            w = w - 2 * lr / len(x) * x.T @ (x @ w - y)
    return w


def _plain_rounds(pdf, rounds, combine, lr=0.05, size=16, epochs=3):
    w, out = np.zeros((3, 2)), []
    state = None
    for _ in range(rounds):
        fits = [(len(g), _plain_fit(w, g, lr, size, epochs)) for _, g in pdf.groupby("client")]
        w, state = combine(w, fits, state)
        out.append(w)
    return out


def _mean(w, fits, state):
    return sum(n * f for n, f in fits) / sum(n for n, _ in fits), None


def _maps(spark, pdf, size=16, lr=0.05, epochs=3):
    df = spark.createDataFrame(pdf)
    return fd.local_maps(fd.batch_grams(df, "client", ["x1", "x2"], ["y", "y2"], "t", size), "client", lr, epochs)


@pytest.mark.parametrize("fold", [256, 2])
def test_rounds_equal_plain_minibatch_descent(spark, monkeypatch, fold):
    """Several epochs over ragged mini-batches; folds of two make several levels."""
    monkeypatch.setattr(fd, "FOLD", fold)
    pdf = _clients([200, 7, 16, 65, 1])
    got = fd.fed_rounds(_maps(spark, pdf), (3, 2), 12).orderBy("round").collect()
    want = _plain_rounds(pdf, 12, _mean)
    assert [r["round"] for r in got] == list(range(1, 13)) and {r["n"] for r in got} == {289}
    for r, w in zip(got, want, strict=True):
        assert np.allclose(r["weights"], w, atol=1e-10)


def test_rounds_reach_pooled_least_squares(spark):
    pdf = _clients([200] * 5)
    df = spark.createDataFrame(pdf)
    maps = fd.local_maps(fd.batch_grams(df, "client", ["x1", "x2"], "y"), "client", 0.2)
    hist = fd.fed_rounds(maps, (3, 1), 60)
    w = np.ravel(hist.orderBy(F.desc("round")).first()["weights"])
    X = np.column_stack([np.ones(len(pdf)), pdf.x1, pdf.x2])
    assert w == pytest.approx(list(np.linalg.lstsq(X, pdf.y, rcond=None)[0]), abs=2e-3)
    ev = fd.evaluate_rounds(df, "client", ["x1", "x2"], "y", hist).collect()
    assert len(ev) == 300 and all(r["loss"] < 0.05 for r in ev if r["round"] == 60)
    for r in ev[:7]:
        g, h = pdf[pdf.client == r["client"]], [x for x in hist.collect() if x["round"] == r["round"]][0]
        p = np.column_stack([np.ones(len(g)), g.x1, g.x2]) @ np.ravel(h["weights"])
        assert (r["n"], r["loss"], r["mae"], r["cos"]) == pytest.approx(
            (len(g), ((p - g.y) ** 2).mean(), abs(p - g.y).mean(), np.sign(p * g.y).mean()))


def test_server_momentum_and_trimmed_mean(spark):
    pdf = _clients([40, 30, 20, 10, 50, 60])
    maps = _maps(spark, pdf)

    def momentum(w, fits, v):
        v = 0.5 * (np.zeros((3, 2)) if v is None else v) + w - _mean(w, fits, None)[0]
        return w - 0.9 * v, v

    def trimmed(w, fits, _):
        values = np.sort(np.stack([f for _, f in fits]), axis=0)
        return values[1:-1].mean(0), None
    got = fd.fed_rounds(maps, (3, 2), 8, fd.momentum(0.5, 0.9)).orderBy("round").collect()
    assert all(np.allclose(r["weights"], w, atol=1e-10) for r, w in zip(got, _plain_rounds(pdf, 8, momentum), strict=True))
    got = fd.fed_rounds_by(maps, (3, 2), 3, fd.trimmed_mean(0.2)).orderBy("round").collect()
    assert all(np.allclose(r["weights"], w, atol=1e-10) for r, w in zip(got, _plain_rounds(pdf, 3, trimmed), strict=True))


def test_plan_does_not_grow_with_steps_or_rounds(spark):
    maps = [_maps(spark, _clients([20, 20]), epochs=e) for e in (2, 500)]
    t0 = time.time()
    plans = [fd.fed_rounds(m, (3, 2), r)._jdf.queryExecution().executedPlan().toString() for m, r in zip(maps, (2, 500), strict=True)]
    assert time.time() - t0 < 4 and len(plans[1]) < 1.1 * len(plans[0])


def test_learning_rate_per_client_column_and_no_clients(spark):
    g = spark.createDataFrame([(1, 0, 2, [[2.0]], [[2.0]], 0.5), (2, 0, 1, [[1.0]], [[1.0]], 0.25)],
                              "client int, batch long, n long, gram array<array<double>>, xty array<array<double>>, lr double")
    maps = fd.local_maps(g, "client", "lr")
    # local: 2*lr/n*c -> client1: 2*0.5/2*2 = 1.0, client2: 2*0.25/1*1 = 0.5; weighted by n
    r = fd.fed_rounds(maps, (1, 1), 1).first()
    assert r["weights"][0] == pytest.approx([(2 * 1.0 + 1 * 0.5) / 3])
    assert fd.fed_rounds(maps.limit(0), (1, 1), 3).count() == 0


def test_profiles_round_robin(spark):
    c = spark.createDataFrame([(i,) for i in range(1, 6)], "client long")
    got = [r["learning_rate"] for r in fd.assign_profiles(c, "client").orderBy("client").collect()]
    assert got == [0.001, 0.005, 0.02, 0.09, 0.001]


def _arx_series(seed, n=2000, phi=0.6, beta=2.5):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(0, 1, n))
    dn = np.zeros(n)
    e = rng.normal(0, 1, n)
    for t in range(1, n):
        dn[t] = phi * dn[t - 1] + e[t]
    y = beta * x + np.cumsum(dn)
    return x, y


def test_arx_recovers_parameters_and_forecasts(spark):
    frames = []
    for s in range(3):
        x, y = _arx_series(s)
        frames.append(pd.DataFrame({"sid": s, "ts": pd.date_range("2024-01-01", periods=len(x), freq="s"),
                                    "x": x, "y": y}))
    df = spark.createDataFrame(pd.concat(frames))
    rows = fc.diff_rows(df, "sid", "ts", "y", ["x"], chunk_us=600_000_000)
    params = fc.fit_arx_diff(fc.arx_gram(rows, "sid", 1), "sid", 1)
    for r in params.collect():
        assert r["phi"] == pytest.approx(0.6, abs=0.06)
        assert r["beta"][0] == pytest.approx(2.5, abs=0.05)
        assert r["n"] == 1998
    warm = fc.fit_arx_diff(fc.arx_gram(rows, "sid", 1), "sid", 1, start=params).collect()
    assert all(abs(w["phi"] - p0["phi"]) < 1e-8 for w, p0 in zip(sorted(warm, key=lambda r: r["sid"]),
                                                               sorted(params.collect(), key=lambda r: r["sid"])))
    mae = fc.in_sample_mae(rows, params, "sid", 1).collect()
    assert all(0.5 < r["mae"] < 1.1 for r in mae)
    # closed-form h-step forecast equals the step-by-step recursion
    state = fc.last_state(fc.diff_rows(df, "sid", "ts", "y", ["x"], first=True), "sid", "ts", 1)
    fut = spark.createDataFrame([(s, h, float(h)) for s in range(3) for h in range(1, 6)], "sid int, h int, x double")
    out = {(r["sid"], r["h"]): r["forecast"] for r in fc.forecast_arx_diff(params, state, fut, "sid", ["x"]).collect()}
    p = {r["sid"]: r for r in params.collect()}
    s0 = {r["sid"]: r for r in state.collect()}
    for s in range(3):
        phi, beta = p[s]["phi"], p[s]["beta"][0]
        n_prev, n_cur = s0[s]["y_T1"] - beta * s0[s]["x0_T1"], s0[s]["y_T"] - beta * s0[s]["x0_T"]
        dn = n_cur - n_prev
        for h in range(1, 6):
            dn = phi * dn
            n_cur = n_cur + dn
            assert out[(s, h)] == pytest.approx(beta * h + n_cur, rel=1e-9, abs=1e-6)


def _exact_loglik(y, xs, phi, beta, sigma2):
    """Gaussian log-likelihood of the differences from their full covariance matrix."""
    u = np.diff(y) - np.diff(np.asarray(xs).reshape(len(y), -1), axis=0) @ np.asarray(beta)
    lag = np.abs(np.subtract.outer(np.arange(len(u)), np.arange(len(u))))
    cov = sigma2 / (1 - phi**2) * phi**lag
    return -0.5 * (len(u) * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + u @ np.linalg.solve(cov, u))


@pytest.mark.parametrize("k", [0, 1, 2])
def test_exact_likelihood(spark, k):
    """The fit's log-likelihood is that of the covariance matrix, and no neighbour has a larger one;
    series of two, three and more observations, nulls left out, a null key, a warm start."""
    rng = np.random.default_rng(k)
    series = {}
    for sid, n in ((None, 40), (1, 25), (2, 9), (3, 60)):
        x, y = _arx_series(sid or 0, n, phi=0.5 if sid != 3 else -0.7)
        series[sid] = y, np.column_stack([x, rng.normal(0, 1, n).cumsum()])[:, :k]
    data = [(sid, T0 + dt.timedelta(hours=i), float(y[i]), *[float(v) for v in x[i]]) for sid, (y, x) in series.items() for i in range(len(y))]
    data += [(1, T0 + dt.timedelta(minutes=30), None, *[0.0] * k), (4, T0, 1.0, *[0.0] * k), (5, T0, 1.0, *[0.0] * k), (5, T0 + dt.timedelta(hours=1), 4.0, *[0.0] * k)]
    cols = [f"x{j}" for j in range(k)]
    df = spark.createDataFrame(data, "sid int, ts timestamp, y double" + "".join(f", {c} double" for c in cols))
    rows = fc.diff_rows(df, "sid", "ts", "y", cols, first=True)
    fit = fc.fit_arx(fc.arx_moments(rows, "sid", k), "sid")
    got = {r["sid"]: r for r in fit.collect()}
    assert set(got) == {None, 1, 2, 3, 5}  # one observation has no difference
    assert (got[5]["n"], got[5]["phi"], got[5]["sigma2"]) == pytest.approx((1, 0.0, 9.0), abs=1e-15)
    for sid, (y, x) in series.items():
        r = got[sid]
        assert r["converged"] and r["n"] == len(y) - 1
        best = _exact_loglik(y, x, r["phi"], r["beta"], r["sigma2"])
        assert r["loglik"] == pytest.approx(best, rel=1e-9)
        for _ in range(30):
            phi = np.clip(r["phi"] + rng.normal(0, 0.01), -0.999, 0.999)
            near = _exact_loglik(y, x, phi, np.array(r["beta"]) + rng.normal(0, 0.01, k), r["sigma2"] * np.exp(rng.normal(0, 0.05)))
            assert near <= best + 1e-9
    warm = {r["sid"]: r for r in fc.fit_arx(fc.arx_moments(rows, "sid", k), "sid", start=fit).collect()}
    assert all(abs(warm[s]["phi"] - got[s]["phi"]) < 1e-9 and warm[s]["iterations"] <= got[s]["iterations"] for s in got)


def _replay_dir(spark, src, cuts):
    """Write ``src`` as one file per time slice, oldest first (distinct mtimes)."""
    import time
    path = os.path.join(tempfile.mkdtemp(prefix="cadence-stream-src-"), "events")
    bounds = [None] + cuts + [None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = src
        if lo is not None:
            part = part.filter(F.col("ts") >= F.lit(lo))
        if hi is not None:
            part = part.filter(F.col("ts") < F.lit(hi))
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path


def _stream_vs_batch(spark, src, path):
    s = st.source(spark, path, src.schema, files_per_batch=1)
    out = st.run_to_table(st.stream_features(s, "user_id", "ts", "1 day", "1 hour"), "t-features")
    got = spark.read.parquet(out)
    e = src.withColumn("ts", F.col("ts").cast("timestamp"))
    wm = e.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    batch = (e.groupBy("user_id", F.window("ts", "1 day").alias("w"))
              .agg(F.count("*").alias("invocations"), F.sum("value").alias("sum_value"))
              .filter(F.col("w.end") <= F.lit(wm)))
    g = {(r["user_id"], r["window_start"]): (r["invocations"], round(r["sum_value"], 6)) for r in got.collect()}
    b = {(r["user_id"], r["w"]["start"]): (r["invocations"], round(r["sum_value"], 6)) for r in batch.collect()}
    return g, b


def test_streaming_features_equal_batch_for_closed_windows(spark):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = _replay_dir(spark, src, [dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)])
    g, b = _stream_vs_batch(spark, src, path)
    assert g == b and len(g) > 0


def test_streaming_drops_late_rows(spark):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    # newest slices first, then the oldest rows. Spark filters late rows with
    # the watermark of the previous batch, so the third batch sees Jan 30.
    import time
    path = os.path.join(tempfile.mkdtemp(prefix="cadence-stream-late-"), "events")
    c1, c2 = dt.datetime(2024, 1, 25), dt.datetime(2024, 1, 20)
    for part in (src.filter(F.col("ts") >= F.lit(c1)),
                 src.filter((F.col("ts") >= F.lit(c2)) & (F.col("ts") < F.lit(c1))),
                 src.filter(F.col("ts") < F.lit(c2))):
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    s = st.source(spark, path, src.schema, files_per_batch=1)
    out = spark.read.parquet(st.run_to_table(st.stream_features(s, "user_id", "ts", "1 day", "1 hour"), "t-late"))
    assert out.filter(F.col("window_end") <= F.lit(c2)).count() == 0
    assert out.filter(F.col("window_start") >= F.lit(c2)).count() > 0


def test_stream_gauges_average_rounds_split_over_batches(spark):
    import time
    rows = [(1, c, c + 1, float(c), 0.5, 1.0) for c in range(6)] + [(2, c, 1, 2.0, 1.0, 3.0) for c in range(3)]
    df = spark.createDataFrame(rows, "round int, client long, n long, loss double, cos double, mae double")
    path = os.path.join(tempfile.mkdtemp(prefix="cadence-gauges-"), "evals")
    for part in (df.filter("client < 3"), df.filter("client >= 3")):   # round 1 spans both files
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    s = st.source(spark, path, df.schema, files_per_batch=1)
    out = spark.read.parquet(st.stream_gauges(s, "t-gauges"))
    got = {(r["name"], r["round"]): r["value"] for r in out.collect()}
    n = sum(c + 1 for c in range(6))
    assert got[("model_loss", 1)] == pytest.approx(sum(c * (c + 1) for c in range(6)) / n)
    assert got[("model_mean_absolute_error", 2)] == pytest.approx(3.0)
    assert len(got) == 6


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path, at = f"{tmp_path}/events", f"{tmp_path}/query"
    c = dt.datetime(2024, 1, 15)
    windows = []
    for part in (src.filter(F.col("ts") < F.lit(c)), src.filter(F.col("ts") >= F.lit(c))):
        part.coalesce(1).write.mode("append").parquet(path)
        s = st.source(spark, path, src.schema)
        out = spark.read.parquet(st.run_to_table(st.stream_features(s, "user_id", "ts", "1 day", "1 hour"), "again", at=at))
        windows.append({(r["user_id"], r["window_start"]) for r in out.collect()})
        assert out.count() == len(windows[-1])
    assert windows[0] < windows[1]


def test_open_windows_and_resumed_streams_equal_batch(spark, tmp_path):
    """At the end of the input every window is there, the open ones too; a query that goes on corrects them."""
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path, at = f"{tmp_path}/events", f"{tmp_path}/query"
    for lo, hi in ((None, 15), (15, None)):
        part = src if hi is None else src.filter(F.col("ts") < F.lit(dt.datetime(2024, 1, hi, 11)))
        part = part if lo is None else part.filter(F.col("ts") >= F.lit(dt.datetime(2024, 1, lo, 11)))
        part.coalesce(1).write.mode("append").parquet(path)
        s = st.source(spark, path, src.schema)
        out = st.run_to_latest(st.stream_features(s, "user_id", "ts", "1 day", "1 hour"), ["user_id", "window_start"], "w", at=at)
        got = {(r["user_id"], r["window_start"]): (r["invocations"], round(r["sum_value"], 6)) for r in out.collect()}
        e = spark.read.schema(src.schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
        want = e.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
        assert got == {(r["user_id"], r["w"]["start"]): (r["n"], round(r["v"], 6)) for r in want.collect()}


def test_empty_stream(spark, tmp_path):
    schema = "user_id long, ts timestamp, value double"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    s = st.source(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    assert st.run_to_latest(st.stream_features(s, "user_id", "ts", "1 day", "1 hour"), ["user_id", "window_start"], "none").count() == 0


def test_rates_from_streamed_panes_equal_batch(spark, tmp_path):
    """Resets inside and between panes, samples on the edge of a pane, several files."""
    rng = np.random.default_rng(5)
    at, data = 0, []
    for i in range(120):
        at += int(rng.integers(1, 9))
        data.append(("c", {"id": str(i % 3)}, T0 + dt.timedelta(seconds=at), float(rng.integers(0, 50))))
    df = spark.createDataFrame(data, "name string, labels map<string,string>, ts timestamp, value double")
    for k in range(3):
        df.filter(F.col("ts") >= F.lit(data[40 * k][2])).filter(F.col("ts") <= F.lit(data[40 * k + 39][2])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
        time.sleep(1.1)
    s = st.source(spark, f"{tmp_path}/s", df.schema, files_per_batch=1)
    panes = st.run_to_latest(st.stream_panes(s, 10, "1 minute"), ["name", "sid", "pane"], "p")
    key = lambda r: (r["labels"]["id"], r["ts"])
    got = {key(r): r["value"] for r in mt.rate_from_panes(panes, 60, 10).collect()}
    want = {key(r): r["value"] for r in mt.counter_rate(df, 60, 10).collect()}
    assert got.keys() == want.keys() and len(got) > 100 and all(got[k] == pytest.approx(want[k]) for k in want)
    with pytest.raises(ValueError):
        mt.rate_from_panes(panes, 55, 10)


def test_huber_map(spark):
    """Two targets with outliers: at the fit the gradient of the Huber loss is zero; nulls are counted; no rows, null weights."""
    rng = np.random.default_rng(2)
    n = 400
    x = rng.normal(0, 1, (n, 2))
    y = np.column_stack([1 + x @ [2.0, -1.0], -3 + x @ [0.5, 0.0]]) + rng.normal(0, 0.3, (n, 2))
    y[rng.integers(0, n, 60), 0] += rng.normal(0, 40, 60)
    cols = ["a", "b", "t1", "t2"]
    pdf = pd.DataFrame(np.column_stack([x, y]), columns=cols)
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0), (1.0, float("nan"), 1.0, 1.0), (1.0, 1.0, float("inf"), 1.0)], "a double, b double, t1 double, t2 double"))
    got = {r["target"]: r for r in fc.huber_map(df, ["a", "b"], ["t1", "t2"], delta=0.5).collect()}
    X = np.column_stack([np.ones(n), x])
    for t, name in enumerate(("t1", "t2")):
        r = got[name]
        e = y[:, t] - X @ r["weights"]
        assert (r["n"], r["n_left_out"], r["converged"]) == (n, 3, True) and r["iterations"] < 40
        assert np.abs(X.T @ np.clip(e, -0.5, 0.5)).max() < 1e-8
        assert r["loss"] == pytest.approx(np.where(abs(e) <= 0.5, 0.5 * e * e, 0.5 * (abs(e) - 0.25)).mean())
    none = fc.huber_map(df.limit(0), ["a"], ["t1"]).first()
    assert (none["weights"], none["loss"], none["n"]) == (None, None, 0)


def test_window_steps(spark):
    w = spark.createDataFrame([(1, [1.0, 2.0], [3.0, None]), (2, [5.0], [6.0])], "id int, x_seq array<double>, y_target array<double>")
    got = sorted(tuple(r) for r in fc.window_steps(w, ["x"], ["y"], ["id"]).collect())
    assert got == [(1, 0, 1.0, 3.0), (1, 1, 2.0, None), (2, 0, 5.0, 6.0)]


@pytest.mark.parametrize("range_s", [60, 55, 10_000])  # a multiple of the step or not; longer than the data
def test_rates_equal_a_count_over_all_samples_and_are_not_copied(spark, range_s):
    """Rates by blocks of instants against plain Python, with gaps, resets, null values and blocks crossed; what is
    shuffled and sorted is a row per step, not one per step and instant."""
    rng = np.random.default_rng(11)
    data, want = [], {}
    for s in range(3):
        at, pts, prev = 0, [], None
        for i in range(150):
            at += int(rng.choice([1, 3, 9, 40, 500]))
            v = None if i % 29 == 7 else float(rng.integers(0, 50))
            data.append(("c", {"id": str(s)}, T0 + dt.timedelta(seconds=at), v))
            pts.append((at, 0.0 if prev is None else None if v is None else v if v < prev else v - prev))
            prev = v
        for k in range(0, (at + range_s) // 10 + 1):
            near = [p for p in pts if 10 * k - range_s < p[0] <= 10 * k]
            if len(near) > 1:
                first = near[0][1]
                total = sum(p[1] for p in near if p[1] is not None)
                want[str(s), T0 + dt.timedelta(seconds=10 * k)] = None if first is None else (total - first) / (near[-1][0] - near[0][0])
    df = spark.createDataFrame(data, "name string, labels map<string,string>, ts timestamp, value double")
    out = mt.counter_rate(df, range_s, 10)
    got = {(r["labels"]["id"], r["ts"]): r["value"] for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] is None if v is None else got[k] == pytest.approx(v) for k, v in want.items())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("RepartitionByExpression")]  # nothing is sorted or shuffled after the instants are made
    assert "Aggregate [" not in above and "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString().split("Window")[0]


def test_streamed_rates_hold_labels_once_and_are_not_copied(spark, tmp_path):
    """State of the panes holds no label map beside the key, and the rates of the panes need no aggregate over copies."""
    df = _samples(spark, [0, 10, 20, 5, 15, 25])
    df.write.parquet(f"{tmp_path}/s")
    panes = st.stream_panes(st.source(spark, f"{tmp_path}/s", df.schema), 2, "1 minute")
    assert "first(labels" not in panes._jdf.queryExecution().analyzed().toString()
    got = st.run_to_latest(panes, ["name", "sid", "pane"], "p")
    assert {tuple(sorted(r["labels"].items())) for r in got.collect()} == {(("instance", "h1"), ("name", "app"))}
    plan = mt.rate_from_panes(got, 4, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" not in plan[:plan.index("RepartitionByExpression")]


@pytest.mark.parametrize("range_s", [60, 55])
def test_samples_of_rates_are_sorted_once_and_not_held_by_an_aggregate(spark, range_s):
    """Samples in the same ranges become one row in the order they are sorted in, also where chunks cut them: no
    aggregate over the samples, no join to them, and the rates don't depend on the chunks. A sample without a time is left out."""
    rng = np.random.default_rng(3)
    at = np.cumsum(rng.choice([1, 2, 3, 200], 200))
    data = [("c", {"id": "1"}, T0 + dt.timedelta(seconds=int(a)), None if i % 31 == 9 else float(rng.integers(0, 50))) for i, a in enumerate(at)]
    data.append(("c", {"id": "1"}, None, 1.0))
    df = spark.createDataFrame(data, "name string, labels map<string,string>, ts timestamp, value double")
    found = []
    for chunk_us in (None, 4_000_000, 3_600_000_000):  # counted rows; several chunks a step; one
        out = mt.counter_rate(df, range_s, 10, chunk_us=chunk_us)
        found.append({r["ts"]: r["value"] for r in out.collect()})
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
        assert not [x for x in plan.splitlines() if "Aggregate [" in x and "_j#" in x.split("], [")[0]]
        done = out._jdf.queryExecution().executedPlan().toString()
        rows = done.split("Union")[0]  # above the rows and what other chunks carry into them
        assert rows.count("Sort [") == 2 and "Aggregate" not in rows
    assert len(found[0]) > 100 and found[0].keys() == found[1].keys() == found[2].keys()
    for k, v in found[0].items():
        assert all(x[k] is None if v is None else x[k] == pytest.approx(v) for x in found[1:])
