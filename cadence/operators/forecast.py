"""Per-series regression with AR(1) errors on first differences.

A SARIMAX(1,1,0) with exogenous regressors and no trend is a regression of
``dy`` on ``dx`` whose errors follow an AR(1). Its exact likelihood needs the
second moments of ``z = [dy, dx...]`` only: over all differences, over neighbours,
and without the first and the last one (:func:`arx_moments`, one grouped aggregate
over the data). For given coefficients the maximum in ``phi`` is the root of a cubic,
for given ``phi`` the coefficients solve normal equations; :func:`fit_arx` iterates
both for all series of a batch at once, inside ``mapInPandas`` over the moments (one
row per series, spread over tasks), so no series' data leaves Spark's partitions.
Conditional least squares (Cochrane-Orcutt, :func:`fit_arx_diff`) is the cheaper
approximation that leaves out the first difference's own term.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.arrays import matrix
from cadence.operators.blocks import chunk_of, materialize, row_blocks, row_index


def _series(series):
    return [series] if isinstance(series, str) else list(series)


def targets_long(df: DataFrame, series, ts: str, targets, exog=(), target_col: str = "target",
                 value_col: str = "y") -> DataFrame:
    """One row per (series, ts, target): every target is fitted, with the
    target name as an extra series key (the fit then runs per
    ``(series, target)`` in the same jobs)."""
    s = _series(series)
    return df.unpivot([*s, ts, *exog], list(targets), target_col, value_col)


def diff_rows(df: DataFrame, series, ts: str, y: str, exog=(), chunk_us: int | None = None,
              first: bool = False) -> DataFrame:
    """Rows ``(series, ts, dy, dy1, dx_j, dx1_j)`` from the third observation
    of each series on (both lags defined). Block-parallel lags (halo 2).

    With ``first`` rows start at the second observation (null ``dy1``, ``dx1_j``), keep the
    levels as ``y_T``, ``x{j}_T``, and observations with a null are left out before
    the differences are taken, so that the first row is the only one without a lag."""
    s, exog = _series(series), list(exog)
    cols = [y] + exog
    d = df.select(*s, ts, *cols)
    if first:
        d = d.dropna("any", subset=[ts, *cols])
    d = row_index(d, s, [ts], chunk_of(ts, chunk_us), "_rn")
    b = row_blocks(d, s, "_rn", 2, 0).repartition(*s, "_blk")
    w = Window.partitionBy(*s, "_blk").orderBy("_rn")
    lags = []
    for c in cols:
        lags += [F.lag(c, 1).over(w).alias(f"{c}__1"), F.lag(c, 2).over(w).alias(f"{c}__2")]
    b = b.select("*", *lags).filter("_core")
    out = [F.col(y) - F.col(f"{y}__1"), F.col(f"{y}__1") - F.col(f"{y}__2")]
    names = ["dy", "dy1"]
    for j, x in enumerate(exog):
        out += [F.col(x) - F.col(f"{x}__1"), F.col(f"{x}__1") - F.col(f"{x}__2")]
        names += [f"dx{j}", f"dx1{j}"]
    now = [F.col(c).cast("double").alias(n) for c, n in zip(cols, _levels(len(exog)))] if first else []
    r = b.select(*s, ts, *now, *[o.cast("double").alias(n) for o, n in zip(out, names)])
    return r.dropna("any", subset=["dy"] if first else names)


def _levels(k: int) -> list[str]:
    return ["y_T"] + [f"x{j}_T" for j in range(k)]


def _z_names(k: int) -> list[str]:
    return ["dy", "dy1"] + [f"dx{j}" for j in range(k)] + [f"dx1{j}" for j in range(k)]


def arx_gram(rows: DataFrame, series, k: int) -> DataFrame:
    """Gram matrix of ``z`` per series: ``(series, n, gram array<array<double>>)``."""
    s = _series(series)
    z = _z_names(k)
    m = len(z)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(F.col(z[i]) * F.col(z[j])).alias(f"_s{i}_{j}") for i in range(m) for j in range(i, m)]
    g = rows.groupBy(*s).agg(*aggs)
    gram = F.array(*[F.array(*[F.col(f"_s{min(i, j)}_{max(i, j)}") for j in range(m)]) for i in range(m)])
    return g.select(*s, "n", gram.alias("gram"))


def _solve(S: np.ndarray, k: int, iters: int, tol: float, phi0: float = 0.0):
    """Cochrane-Orcutt on the Gram matrix ``S`` of z (order of ``_z_names``),
    starting from ``phi0`` (0 = plain OLS first)."""
    m = 2 + 2 * k
    ix = list(range(2, 2 + k))
    ix1 = list(range(2 + k, 2 + 2 * k))

    def unit(i):
        e = np.zeros(m)
        e[i] = 1.0
        return e

    def ols(phi):
        ay = unit(0) - phi * unit(1)
        if k == 0:
            return np.zeros(0), ay, np.zeros((m, 0))
        ax = np.stack([unit(ix[j]) - phi * unit(ix1[j]) for j in range(k)], axis=1)
        beta = np.linalg.lstsq(ax.T @ S @ ax, ax.T @ S @ ay, rcond=None)[0]
        return beta, ay, ax

    def ar(beta):
        vu = unit(0) - sum((beta[j] * unit(ix[j]) for j in range(k)), np.zeros(m))
        vu1 = unit(1) - sum((beta[j] * unit(ix1[j]) for j in range(k)), np.zeros(m))
        den = vu1 @ S @ vu1
        return float(vu @ S @ vu1 / den) if den != 0 else 0.0

    phi = float(phi0)
    beta, ay, ax = ols(phi)
    done, steps = False, 0
    while not done and steps < max(1, iters):
        new_phi = ar(beta)
        beta, ay, ax = ols(new_phi)
        done, phi, steps = abs(new_phi - phi) < tol, new_phi, steps + 1
    r = ay - (ax @ beta if k else 0.0)
    sse = float(r @ S @ r)
    return phi, beta, sse, steps, done


def fit_arx_diff(gram: DataFrame, series, k: int, iters: int = 50, tol: float = 1e-10,
                 start: DataFrame | None = None) -> DataFrame:
    """Per-series ``phi``, ``beta`` (k), ``n`` and in-sample one-step ``mse``
    (T7, T9). ``iters=1``: one Cochrane-Orcutt step from OLS. ``start``: a
    previous parameter table; its ``phi`` warm-starts each series. ``iterations``
    and ``converged`` tell whether ``iters`` was enough."""
    s = _series(series)
    if start is not None:
        gram = gram.join(start.select(*s, F.col("phi").alias("_phi0")), s, "left")
    key_fields = [f for f in gram.schema.fields if f.name in s]
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)
    schema = f"{key_ddl}, n long, phi double, beta array<double>, mse double, iterations int, converged boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rec in pdf.itertuples(index=False):
                r = rec._asdict()
                S = np.array([np.asarray(row, dtype=float) for row in r["gram"]])
                phi0 = r.get("_phi0")
                phi0 = 0.0 if phi0 is None or phi0 != phi0 else phi0
                phi, beta, sse, steps, done = _solve(S, k, iters, tol, phi0)
                row = {c: r[c] for c in s}
                row.update(n=int(r["n"]), phi=phi, beta=[float(b) for b in beta],
                           mse=sse / r["n"] if r["n"] else None, iterations=steps, converged=bool(done))
                out.append(row)
            yield pd.DataFrame(out, columns=[*s, "n", "phi", "beta", "mse", "iterations", "converged"])

    return gram.mapInPandas(run, schema)


def arx_moments(rows: DataFrame, series, k: int) -> DataFrame:
    """``(series, n, whole, near, first, last)`` from :func:`diff_rows` with ``first``: the
    second moments of ``z = [dy, dx...]`` over all ``n`` differences, those of each with
    the one before it (row: later), and the first and last ``z``."""
    s = _series(series)
    z, z1 = ["dy"] + [f"dx{j}" for j in range(k)], ["dy1"] + [f"dx1{j}" for j in range(k)]
    m = range(k + 1)
    ts = [c for c in rows.columns if c not in {*s, *z, *z1, *_levels(k)}][0]
    aggs = [F.count(F.lit(1)).alias("n"), F.max_by(F.array(*z), ts).alias("last")]
    aggs += [F.sum(F.when(F.col("dy1").isNull(), F.col(z[i]))).alias(f"_f{i}") for i in m]
    aggs += [F.sum(F.col(z[i]) * F.col(z[j])).alias(f"_w{i}_{j}") for i in m for j in m if i <= j]
    aggs += [F.coalesce(F.sum(F.col(z[i]) * F.col(z1[j])), F.lit(0.0)).alias(f"_n{i}_{j}") for i in m for j in m]
    g = rows.groupBy(*s).agg(*aggs)
    return g.select(*s, "n", matrix(k + 1, k + 1, lambda i, j: F.col(f"_w{min(i, j)}_{max(i, j)}")).alias("whole"),
                    matrix(k + 1, k + 1, lambda i, j: F.col(f"_n{i}_{j}")).alias("near"),
                    F.array(*[F.col(f"_f{i}") for i in m]).alias("first"), "last")


def _phi(m: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The ``phi`` of greatest exact likelihood for residual moments ``a`` (all), ``b`` (neighbours)
    and ``c`` (without the ends): the root in (-1, 1) of a cubic that falls there from
    ``m``-independent positive to negative, by bisection to the last bit."""
    lo, hi = -np.ones(len(m)), np.ones(len(m))
    for _ in range(60):
        x = (lo + hi) / 2
        up = ((m - 1) * c * x - (m - 2) * b) * x * x - (m * c + a) * x + m * b > 0
        lo, hi = np.where(up, x, lo), np.where(up, hi, x)
    return np.where(a > 0, (lo + hi) / 2, 0.0)


def exact_fit(n: np.ndarray, whole: np.ndarray, near: np.ndarray, first: np.ndarray, last: np.ndarray, iters: int,
              tol: float, phi: np.ndarray) -> dict[str, np.ndarray]:
    """Maximum likelihood for many series at once, from ``phi``: ``phi``, ``beta``,
    ``sigma2``, ``loglik``, ``iterations``, ``converged``."""
    k = whole.shape[1] - 1
    ends = first[:, :, None] * first[:, None, :] + last[:, :, None] * last[:, None, :]
    inner = np.where((n > 1)[:, None, None], whole - ends, 0.0)
    both = near + near.transpose(0, 2, 1)

    def coefficients(phi: np.ndarray) -> np.ndarray:
        f = phi[:, None, None]
        q = whole - f * both + f * f * inner
        return (np.linalg.pinv(q[:, 1:, 1:], hermitian=True) @ q[:, 1:, :1])[:, :, 0] if k else np.zeros((len(n), 0))

    def moments(beta: np.ndarray) -> list[np.ndarray]:
        v = np.concatenate([np.ones((len(n), 1)), -beta], axis=1)
        return [np.einsum("si,sij,sj->s", v, x, v) for x in (whole, near, inner)]
    steps, done = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
    beta = coefficients(phi)
    for _ in range(iters):
        new = np.where(done, phi, _phi(n, *moments(beta)))
        steps += ~done
        done = done | (np.abs(new - phi) < tol)
        phi = new
        beta = coefficients(phi)
        if done.all():
            break
    a, b, c = moments(beta)
    s = a - 2 * phi * b + phi * phi * c
    with np.errstate(divide="ignore"):
        loglik = -n / 2 * (np.log(2 * np.pi * s / n) + 1) + np.log(1 - phi * phi) / 2
    return {"phi": phi, "beta": beta, "sigma2": s / n, "loglik": loglik, "iterations": steps, "converged": done}


def fit_arx(moments: DataFrame, series, iters: int = 500, tol: float = 1e-14, start: DataFrame | None = None) -> DataFrame:
    """SARIMAX(1,1,0) by exact maximum likelihood (T7): ``(series, n, phi, beta, sigma2,
    loglik, iterations, converged)`` from :func:`arx_moments`.

    ``start``: an earlier parameter table, whose ``phi`` warm-starts each series. A
    series without a difference has no row; regressors that don't vary get the
    coefficient of least norm; a series that is fitted exactly has ``loglik``
    infinite. ``converged`` tells whether ``iters`` was enough for ``tol``."""
    s = _series(series)
    if start is not None:
        same = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(s)]
        known = start.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(s)], F.col("phi").alias("_phi0"))
        moments = moments.join(known, same, "left").drop(*[f"_s{i}" for i in range(len(s))])
    else:
        moments = moments.withColumn("_phi0", F.lit(0.0))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moments.schema.fields if f.name in s)
    names = ["phi", "beta", "sigma2", "loglik", "iterations", "converged"]
    schema = f"{keys}, n long, phi double, beta array<double>, sigma2 double, loglik double, iterations int, converged boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            whole, near = (np.array([np.stack(x) for x in pdf[c]], float) for c in ("whole", "near"))
            first, last = (np.array([np.asarray(x, float) for x in pdf[c]]) for c in ("first", "last"))
            fit = exact_fit(pdf["n"].to_numpy(), whole, near, first, last, iters, tol, pdf["_phi0"].fillna(0.0).to_numpy(float))
            fit["beta"] = list(fit["beta"])
            yield pd.concat([pdf[[*s, "n"]].reset_index(drop=True), pd.DataFrame({c: fit[c] for c in names})], axis=1)

    order = [f.name for f in moments.schema.fields if f.name in s]
    return moments.select(*order, "n", "whole", "near", "first", "last", "_phi0").mapInPandas(run, schema)


def in_sample_mae(rows: DataFrame, params: DataFrame, series, k: int) -> DataFrame:
    """Mean absolute one-step residual per series (T9), a pass over the
    difference rows joined with the fitted parameters."""
    s = _series(series)
    d = rows.join(params.select(*s, "phi", "beta"), s, "inner")
    e = F.col("dy") - F.col("phi") * F.col("dy1")
    for j in range(k):
        e = e - F.element_at("beta", j + 1) * (F.col(f"dx{j}") - F.col("phi") * F.col(f"dx1{j}"))
    return d.groupBy(*s).agg(F.avg(F.abs(e)).alias("mae"))


def last_state(rows: DataFrame, series, ts: str, k: int) -> DataFrame:
    """Last two observations of ``y`` and the exog per series, as columns ``y_T, y_T1, x{j}_T,
    x{j}_T1``, from :func:`diff_rows` with ``first``: the last level and the last
    difference, one grouped aggregate."""
    s = _series(series)
    steps = ["dy"] + [f"dx{j}" for j in range(k)]
    now = _levels(k)
    last = rows.groupBy(*s).agg(F.max_by(F.struct(*now, *steps), ts).alias("_l"), F.max(ts).alias("t_last"))
    return last.select(*s, "t_last", *[F.col(f"_l.{c}").alias(c) for c in now],
                       *[(F.col(f"_l.{c}") - F.col(f"_l.{d}")).alias(f"{c}1") for c, d in zip(now, steps)])


def forecast_arx_diff(params: DataFrame, state: DataFrame, future: DataFrame, series, exog, h_col: str = "h"):
    """h-step forecasts (T8) in closed form. With ``n_t = y_t - beta'x_t`` and
    ``dn`` following the AR(1): ``y_{T+h} = beta'x_{T+h} + n_T + dn_T *
    sum_{i=1..h} phi^i``. ``future`` holds ``(series, h, exog...)`` with the
    caller's future exog (T8 takes it as an input)."""
    s, exog = _series(series), list(exog)
    d = future.join(params.select(*s, "phi", "beta"), s).join(state, s)
    beta = [F.element_at("beta", j + 1) for j in range(len(exog))]
    bx = lambda suf: sum((b * F.col(f"x{j}{suf}") for j, b in enumerate(beta)), F.lit(0.0))
    n_T = F.col("y_T") - bx("_T")
    dn_T = n_T - (F.col("y_T1") - bx("_T1"))
    phi, h = F.col("phi"), F.col(h_col).cast("double")
    geo = F.when(phi == 1.0, h).otherwise(phi * (1 - F.pow(phi, h)) / (1 - phi))
    fx = sum((b * F.col(x).cast("double") for b, x in zip(beta, exog)), F.lit(0.0))
    return d.select(*s, h_col, *[c for c in future.columns if c not in s and c != h_col and c not in exog],
                    (fx + n_T + dn_T * geo).alias("forecast"))


def window_steps(windows: DataFrame, inputs, targets, keys=()) -> DataFrame:
    """Every step of every window as a row (M7): the arrays ``<input>_seq`` and
    ``<target>_target`` side by side, under the names of the columns. Steps with a null stay null."""
    cols = [(f"{c}_seq", c) for c in inputs] + [(f"{c}_target", c) for c in targets]
    steps = F.arrays_zip(*[F.col(a) for a, _ in cols])
    d = windows.select(*keys, F.posexplode(steps).alias("step", "_s"))
    return d.select(*keys, "step", *[F.col("_s")[a].alias(c) for a, c in cols])


def huber_map(df: DataFrame, features, targets, delta: float = 1.0, max_iter: int = 200, tol: float = 1e-11) -> DataFrame:
    """One linear map for several targets under the mean Huber loss (M7): ``(target, weights,
    loss, n, n_left_out, iterations, converged)``, the first weight the intercept.

    Iteratively reweighted least squares: every pass is one aggregate over the rows
    that gives, for each target, the loss and the weighted Gram sums with which the
    next weights are solved (errors beyond ``delta`` weigh ``delta / |error|``). The sums
    over the small errors alone come along: their Newton step ends most fits in a few
    passes, and is taken back by a reweighted one where the loss has not fallen. Only
    sums of the model's size reach the driver. Rows with a null or non-finite value
    cannot be fitted; they are left out and counted. No rows: null weights."""
    features, targets = list(features), list(targets)
    cols = [F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, *targets])]
    finite = reduce(lambda x, y: x & y, [F.coalesce(F.abs(F.col(c)) < F.lit(float("inf")), F.lit(False)) for c in [*features, *targets]])
    rows = materialize(df.select(*cols).withColumn("_ok", finite))
    data = rows.where("_ok")
    n, out = rows.agg(F.count_if("_ok"), F.count_if(~F.col("_ok"))).first()
    x = [F.lit(1.0)] + [F.col(f) for f in features]
    p, upper = len(x), [(i, j) for i in range(len(x)) for j in range(i, len(x))]

    def sums(w: np.ndarray) -> list[dict]:
        """For each target: loss, and both kinds of (Gram, right side)."""
        aggs = []
        for t, name in enumerate(targets):
            e = F.col(name) - reduce(lambda a, b: a + b, [F.lit(float(w[t, i])) * x[i] for i in range(p)])
            small = F.abs(e) <= delta
            share = F.when(small, 1.0).otherwise(F.lit(delta) / F.abs(e))
            one, y = F.when(small, 1.0).otherwise(0.0), F.col(name)
            aggs.append(F.sum(F.when(small, 0.5 * e * e).otherwise(delta * (F.abs(e) - 0.5 * delta))))
            aggs += [F.sum(k * x[i] * x[j]) for k in (share, one) for i, j in upper]
            aggs += [F.sum(share * x[i] * y) for i in range(p)]
            aggs += [F.sum(x[i] * F.when(small, y).otherwise(F.lit(delta) * F.signum(e))) for i in range(p)]
        flat = np.array(data.agg(*[a.alias(f"_{k}") for k, a in enumerate(aggs)]).first(), float).reshape(len(targets), -1)
        found = []
        for r in flat:
            grams = []
            for k in range(2):
                g = np.zeros((p, p))
                for (i, j), v in zip(upper, r[1 + k * len(upper):1 + (k + 1) * len(upper)]):
                    g[i, j] = g[j, i] = v
                grams.append(g)
            c = r[1 + 2 * len(upper):].reshape(2, p)
            found.append({"loss": r[0], "reweighted": (grams[0], c[0]), "newton": (grams[1], c[1])})
        return found

    def solved(system: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.linalg.lstsq(*system, rcond=None)[0]
    w = np.zeros((len(targets), p))
    steps, done = np.zeros(len(targets), int), np.zeros(len(targets), bool)
    held: list[dict | None] = [None] * len(targets)  # the sums at the weights with the least loss so far
    while n and not done.all() and steps.max() < max_iter:
        for t, now in enumerate(sums(w)):
            if done[t]:
                continue
            steps[t] += 1
            best = held[t]
            if best is not None and now["loss"] > best["loss"] * (1 + 1e-12):
                w[t] = solved(best["reweighted"])  # a step that always lowers the loss
                held[t] = None
                continue
            new = solved(now["newton" if best is not None else "reweighted"])
            done[t] = np.abs(new - w[t]).max() <= tol * (1 + np.abs(new).max())
            held[t], w[t] = now, new
    loss = [float(s["loss"] / n) for s in sums(w)] if n else [None] * len(targets)
    fit = [(name, w[t].tolist() if n else None, loss[t], n, out, int(steps[t]), bool(done[t])) for t, name in enumerate(targets)]
    return df.sparkSession.createDataFrame(
        fit, "target string, weights array<double>, loss double, n long, n_left_out long, iterations int, converged boolean")


def linear_huber(df: DataFrame, features, label: str, epsilon: float = 1.35, max_iter: int = 100):
    """Huber-loss linear regression (M7) with Spark ML (distributed L-BFGS); one row
    ``(coefficients, intercept, scale, n, n_left_out, iterations, converged)``. Rows
    with a null or non-finite value can't be fitted: they are left out and counted."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    va = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="error")
    cols = [F.col(c).cast("double").alias(c) for c in features] + [F.col(label).cast("double").alias("_y")]
    finite = [F.coalesce(F.abs(F.col(c)) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(c) for c in [*features, "_y"]]
    rows = df.select(*cols).withColumn("_ok", reduce(lambda x, y: x & y, finite))
    counts = rows.agg(F.count_if("_ok").alias("n"), F.count_if(~F.col("_ok")).alias("out")).first()
    data = va.transform(rows.where("_ok")).select("_f", "_y")
    model = LinearRegression(featuresCol="_f", labelCol="_y", loss="huber", epsilon=epsilon,
                             maxIter=max_iter, regParam=0.0).fit(data)
    spark = df.sparkSession
    done = model.summary.totalIterations
    return spark.createDataFrame(
        [(list(map(float, model.coefficients)), float(model.intercept), float(model.scale), counts["n"], counts["out"], done, done < max_iter)],
        "coefficients array<double>, intercept double, scale double, n long, n_left_out long, iterations int, converged boolean")
