"""Federated averaging as DataFrame jobs.

Clients are rows keyed by a client column, not processes. A linear model of
several targets with squared loss is trained the federated way: every client
takes gradient steps over its ordered mini-batches from the global weights, the
server aggregates the local weights by sample count.

A gradient step over a batch is affine in the weights, ``W <- M W + V``, and M and
V come from the batch's Gram sums (one grouped aggregate over the data). Steps
compose, so a client's whole local fit (all batches, all epochs) is one affine
map, folded from its batches in bounded chunks; and the average of affine maps is
one more. All rounds of an averaging server are then a fold over a single row, in
the job that computes it: no job per round, no weights through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.arrays import each, matrix
from cadence.operators.blocks import materialize, row_index
from cadence.operators.evaluate import forecast_metrics


def _keys(by):
    return [by] if isinstance(by, str) else list(by or [])


# Client profiles of the reference deployment (fixed values): learning rate and
# batch size per profile, assigned round-robin as profile (i - 1) mod 4.
PROFILES = [
    {"profile": 0, "learning_rate": 0.001, "batch_size": 32},
    {"profile": 1, "learning_rate": 0.005, "batch_size": 256},
    {"profile": 2, "learning_rate": 0.02, "batch_size": 64},
    {"profile": 3, "learning_rate": 0.09, "batch_size": 128},
]


def assign_profiles(clients: DataFrame, client: str, seed: int | None = None) -> DataFrame:
    """Attach a profile to every client (X7): round-robin on the 1-based
    client number, or a seeded hash choice when ``seed`` is given."""
    n = len(PROFILES)
    if seed is None:
        idx = F.pmod(F.col(client).cast("long") - 1, F.lit(n))
    else:
        h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(client).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10)
        idx = F.pmod(h.cast("long"), F.lit(n))
    lr = F.element_at(F.array(*[F.lit(p["learning_rate"]) for p in PROFILES]), idx.cast("int") + 1)
    bs = F.element_at(F.array(*[F.lit(p["batch_size"]) for p in PROFILES]), idx.cast("int") + 1)
    return clients.select("*", idx.cast("int").alias("profile"), lr.alias("learning_rate"), bs.alias("batch_size"))


def fedavg_weights(weights: DataFrame, by=("round", "layer"), w: str = "weights", n: str = "n") -> DataFrame:
    """Element-wise sample-weighted mean of weight arrays.

    ``posexplode`` -> ``sum(w*n)/sum(n)`` per (group, position) -> arrays
    re-assembled in position order. Group size is bounded by the layer size.
    """
    k = _keys(by)
    e = weights.select(*k, F.col(n).alias("_n"), F.posexplode(w).alias("_pos", "_w"))
    per = e.groupBy(*k, "_pos").agg(F.try_divide(F.sum(F.col("_w") * F.col("_n")), F.sum("_n")).alias("_m"),
                                   F.sum("_n").alias("_nt"))
    return per.groupBy(*k).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda x: x["_m"]).alias(w),
        F.max("_nt").alias(n))


#: Maps folded at a time; a client of more batches takes several levels of folds.
FOLD = 256
WEIGHTS = "array<array<double>>"


def inputs_of(features, intercept: bool = True) -> list[Column]:
    """Input columns of the model; the first is the constant 1 when ``intercept``."""
    return ([F.lit(1.0)] if intercept else []) + [F.col(f).cast("double") for f in features]


def batch_grams(df: DataFrame, client: str, features, targets, order=None, batch_size=None,
                intercept: bool = True) -> DataFrame:
    """Sufficient statistics of least squares per client and mini-batch (X2 input):
    ``(client, batch, n, gram p x p, xty p x q)``.

    A client's rows are cut by ``order`` into batches of ``batch_size`` rows (a
    number, or a column with the client's own); the last may be shorter. Without a
    size all rows are one batch. Rows with a null input or target must be dropped
    before. The batch numbers come from chunked row numbers, so a client that holds
    a third of the data is spread like any other."""
    xs, ys = inputs_of(features, intercept), [F.col(t).cast("double") for t in _keys(targets)]
    p, q = len(xs), len(ys)
    if batch_size is None:
        d = df.withColumn("batch", F.lit(0).cast("long"))
    else:
        size = F.col(batch_size) if isinstance(batch_size, str) else F.lit(int(batch_size))
        d = row_index(df, [client], _keys(order), None, "_rn")
        d = d.withColumn("batch", F.floor((F.col("_rn") - 1) / size).cast("long"))
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(xs[i] * xs[j]).alias(f"_g{i}_{j}") for i in range(p) for j in range(i, p)]
    aggs += [F.sum(xs[i] * ys[t]).alias(f"_c{i}_{t}") for i in range(p) for t in range(q)]
    g = d.groupBy(client, "batch").agg(*aggs)
    return g.select(client, "batch", "n", matrix(p, p, lambda i, j: F.col(f"_g{min(i, j)}_{max(i, j)}")).alias("gram"),
                    matrix(p, q, lambda i, t: F.col(f"_c{i}_{t}")).alias("xty"))


def step_map(gram: Column, xty: Column, n: Column, lr: Column) -> Column:
    """The affine map ``[M | V]`` (p rows of p + q numbers) of one gradient step of mean
    squared error: ``W <- W - 2 lr / n (gram W - xty)``."""
    k = F.lit(2.0) * lr / n
    rows = F.sequence(F.lit(0), F.size(gram) - 1)
    return F.transform(rows, lambda i: F.concat(
        F.zip_with(rows, F.get(gram, i), lambda j, g: F.when(i == j, 1.0).otherwise(0.0) - k * g),
        F.transform(F.get(xty, i), lambda c: k * c)))


def _times(row: Column, first: Column, start: Column) -> Column:
    """``start`` plus the rows of ``first``, each times its number in ``row``."""
    return F.aggregate(F.sequence(F.lit(0), F.size(first) - 1), start,
                       lambda s, k: F.zip_with(s, F.get(first, k), lambda a, b: a + F.get(row, k) * b))


def composed(then: Column, first: Column) -> Column:
    """The affine map that applies ``first`` and then ``then``."""
    p = F.size(then)
    return F.transform(then, lambda row: _times(row, first, F.concat(F.array_repeat(F.lit(0.0), p), F.slice(row, p + 1, F.size(row) - p))))


def moved(by: Column, w: Column) -> Column:
    """Weights (p x q) after an affine map."""
    p = F.size(by)
    return F.transform(by, lambda row: _times(row, w, F.slice(row, p + 1, F.size(row) - p)))


def local_maps(batches: DataFrame, client: str, lr, epochs: int = 1) -> DataFrame:
    """``(client, n, map)``: a client's whole local fit as one affine map: its batches
    in order, ``epochs`` times over (X2). ``lr`` is a number or a column.

    Composition is associative: chunks of FOLD batches are folded, then chunks of
    chunks, so no task holds more than FOLD maps of a client. The plan's size
    depends on neither the batches nor the epochs."""
    rate = F.col(lr) if isinstance(lr, str) else F.lit(float(lr))
    d = batches.select(client, F.col("batch").alias("_at"), "n", step_map(F.col("gram"), F.col("xty"), F.col("n"), rate).alias("map"))
    last = batches.agg(F.max("batch")).first()[0] or 0
    while last > 0:
        g = d.groupBy(client, F.floor(F.col("_at") / FOLD).cast("long").alias("_to")).agg(
            F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("_at", "map"))).alias("_s"))
        steps = F.col("_s.map")
        whole = F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), F.get(steps, F.lit(0)), lambda done, m: composed(m, done))
        d = g.select(client, F.col("_to").alias("_at"), "n", whole.alias("map"))
        last //= FOLD
    if epochs > 1:
        again = F.aggregate(F.sequence(F.lit(2), F.lit(epochs)), F.col("map"), lambda done, _: composed(F.col("map"), done))
        d = d.withColumn("map", again)
    return d.select(client, "n", "map")


# --------------------------------------------------------------------------- servers

Server = Callable[[Column, Column], Column]


def averaged(state: Column, mean: Column) -> Column:
    """The global weights are the sample-weighted mean of the local ones."""
    return F.struct(mean.alias("w"), state["v"].alias("v"))


def momentum(beta: float, rate: float = 1.0) -> Server:
    """A server that moves along the decayed sum of the rounds' updates:
    ``v <- beta v + (w - mean)``, ``w <- w - rate v``."""
    def step(state: Column, mean: Column) -> Column:
        v = each(state["v"], each(state["w"], mean, lambda a, b: a - b), lambda a, b: F.lit(beta) * a + b)
        w = each(state["w"], v, lambda a, b: a - F.lit(rate) * b)
        return F.struct(w.alias("w"), v.alias("v"))
    return step


def fed_rounds(maps: DataFrame, shape: tuple[int, int], rounds: int, server: Server = averaged,
               w0: list[list[float]] | None = None) -> DataFrame:
    """All rounds (X6): ``(round, n, weights p x q)`` from the clients' maps.

    ``server`` is the aggregation (D5): it gets the state (``w`` and a memory ``v``, zero
    at first) and the sample-weighted mean of the local weights, and returns the next
    state. The mean of the clients' maps is one global aggregate of p * (p + q) sums;
    the rounds are a fold over its single row. No clients, no rounds."""
    p, q = shape
    n = F.col("n")
    g = maps.agg(F.sum(n).alias("n"), *[F.sum(F.get(F.get("map", F.lit(i)), F.lit(j)) * n).alias(f"_m{i}_{j}") for i in range(p) for j in range(p + q)])
    mean = matrix(p, p + q, lambda i, j: F.col(f"_m{i}_{j}") / n)
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), q), p)
    start = matrix(p, q, lambda i, t: F.lit(float(w0[i][t]))) if w0 is not None else zeros
    one = F.struct(start.alias("w"), zeros.alias("v"))

    def turn(done: Column, _: Column) -> Column:
        state = F.element_at(done, -1)
        return F.concat(done, F.array(server(state, moved(F.col("_map"), state["w"]))))
    states = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(one), turn)
    h = g.where(n.isNotNull()).select("n", mean.alias("_map")).select("n", F.posexplode(states).alias("round", "_s"))
    return h.where("round > 0").select("round", "n", F.col("_s.w").alias("weights"))


def trimmed_mean(share: float) -> Callable[[DataFrame, tuple[int, int]], DataFrame]:
    """An aggregation that leaves out, for every single weight, the ``floor(share * clients)``
    smallest and largest local values and averages the others, each client alike."""
    def combine(local: DataFrame, shape: tuple[int, int]) -> DataFrame:
        p, q = shape
        long = local.select(F.posexplode(F.flatten("weights")).alias("_pos", "_w"))
        r = row_index(long, ["_pos"], ["_w"], None, "_rn", total="_k")
        cut = F.floor(F.lit(share) * F.col("_k"))
        m = r.where((F.col("_rn") > cut) & (F.col("_rn") <= F.col("_k") - cut)).groupBy("_pos").agg(F.avg("_w").alias("_m"))
        one = m.agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda x: x["_m"]).alias("_flat"))
        return one.select(matrix(p, q, lambda i, t: F.get("_flat", F.lit(i * q + t))).alias("weights"))
    return combine


def fed_rounds_by(maps: DataFrame, shape: tuple[int, int], rounds: int, combine, w0: list[list[float]] | None = None) -> DataFrame:
    """Rounds of an aggregation that needs every local weight (not only their mean):
    ``combine`` gets the local weights ``(client, n, weights)`` and returns one row of
    global ``weights``. Each round is written as a one-row table, which the next
    reads as a scalar subquery. ``(round, weights)``."""
    p, q = shape
    start = w0 if w0 is not None else [[0.0] * q for _ in range(p)]
    state = maps.sparkSession.createDataFrame([(start,)], f"weights {WEIGHTS}")
    maps, done = materialize(maps), []
    for r in range(1, rounds + 1):
        local = maps.withColumn("_w", state.scalar()).withColumn("weights", moved(F.col("map"), F.col("_w"))).drop("map", "_w")
        state = materialize(combine(local, shape).select("weights"))
        done.append(state.select(F.lit(r).alias("round"), "weights"))
    return reduce(DataFrame.unionByName, done)


# --------------------------------------------------------------------------- evaluation

def evaluate_rounds(df: DataFrame, client: str, features, targets, history: DataFrame, intercept: bool = True) -> DataFrame:
    """Every round's global weights on every client's rows (X4, X8): ``(round, client, n,
    loss, mae, huber, cos)`` over all targets, as :func:`forecast_metrics` defines them.

    The history (rounds x model) is a scalar subquery; one pass over the rows
    evaluates all rounds, and rows meet in partial sums per client and round."""
    xs, targets = inputs_of(features, intercept), _keys(targets)
    h = history.agg(F.array_sort(F.collect_list(F.struct("round", "weights"))).alias("h")).scalar()
    d = df.select(client, *[x.alias(f"_x{i}") for i, x in enumerate(xs)], *[F.col(t).cast("double").alias(f"actual_{t}") for t in targets],
                  F.explode(h).alias("_h"))
    w = F.col("_h.weights")
    for t, name in enumerate(targets):
        terms = [F.col(f"_x{i}") * F.get(F.get(w, F.lit(i)), F.lit(t)) for i in range(len(xs))]
        d = d.withColumn(f"predicted_{name}", reduce(lambda a, b: a + b, terms))
    return forecast_metrics(d.withColumn("round", F.col("_h.round")), targets, by=["round", client])
