"""Counter / gauge queries on a samples table ``(name, labels, ts, value)``
(P14, P15, W9, A13, A14, G1-G7, F14, F15).

A series is one (name, labels) pair. Range functions are evaluated on a step
grid, as a dashboard does: samples that are in the ranges ``(t - range, t]`` of the
same instants become one row, and blocks of instants get the rows that reach into
them. No window spans a whole series, and no row is copied to all its instants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.labels import label, label_match
from cadence.functions.time import epoch_us
from pyspark.sql import Window

from cadence.operators.blocks import chunk_of, previous, time_blocks


def match_labels(df: DataFrame, matchers, name: str | None = None, name_regex: str | None = None,
                 labels: str = "labels") -> DataFrame:
    """Selector ``name{k op "v", ...}`` (P14): ``matchers`` is a list of
    ``(key, op, value)`` with op in ``= != =~ !~``; regexes are anchored and a
    missing label reads as ''."""
    c = F.lit(True)
    if name is not None:
        c = c & (F.col("name") == F.lit(name))
    if name_regex is not None:
        c = c & F.col("name").rlike(f"^(?:{name_regex})$")
    for k, op, v in matchers:
        c = c & label_match(k, op, v, labels)
    return df.filter(c)


def series_key(labels: str = "labels") -> Column:
    """Stable identity of a label set (sorted entries)."""
    return F.array_sort(F.map_entries(F.col(labels)))


def counter_rate(df: DataFrame, range_s: int, step_s: int, labels: str = "labels",
                 chunk_us: int | None = None) -> DataFrame:
    """Per-second increase of counters over ``(t - range, t]`` at every
    evaluation instant ``t`` (a multiple of ``step``) (W9).

    A drop in value is a counter reset: the increase across it is the new value.
    The rate is ``(sum of increases after the first sample in range) / (last
    sample time - first sample time)``; fewer than two samples give no row.
    Output: ``name, labels, ts, value``.
    """
    range_us, step_us = range_s * 1_000_000, step_s * 1_000_000
    us = epoch_us("ts")
    first = F.expr(f"(_us + {step_us - 1}) div {step_us}")  # the first instant t = k*step with us <= t
    last = F.expr(f"(_us + {range_us - 1}) div {step_us}")  # the last with t < us + range
    pane = ["_j", "_last"]  # samples that are in the same ranges
    # the key holds the whole label set, so the map itself need not travel
    d = df.select("name", series_key(labels).alias("_sid"), us.alias("_us"), "value", *([chunk_of("ts", chunk_us).alias("_c")] if chunk_us else []))
    d = d.withColumns({"_j": first, "_last": F.col("_j") + F.lit(range_us // step_us - 1) if range_us % step_us == 0 else last})
    d = previous(d, ["name", "_sid"], ["_us"], F.col("_c") if chunk_us else None, ["value"], "_prev", within=pane, keep_chunk=True)
    inc = (F.when(F.col("value_prev").isNull(), F.lit(0.0))
            .when(F.col("value") < F.col("value_prev"), F.col("value"))
            .otherwise(F.col("value") - F.col("value_prev")))
    # they become one row (one per chunk that they are in) in the order they are sorted in: no aggregate holds them
    w = Window.partitionBy("name", "_sid", "_ck", *pane).orderBy("_us")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = d.select("name", "_sid", "_ck", *pane, "_us", inc.alias("_inc")).select(
        "name", "_sid", *pane, F.row_number().over(w).alias("_rn"), F.count(F.lit(1)).over(whole).alias("_n"),
        F.col("_us").alias("_t0"), F.last("_us").over(whole).alias("_t1"),
        F.sum("_inc").over(whole).alias("_s"), F.min_by("_inc", "_us").over(whole).alias("_i0"))
    return _rates(e.filter("_rn = 1").drop("_rn"), range_us, step_us).select(
        "name", F.map_from_entries("_sid").alias(labels), "ts", "value")


def _rates(e: DataFrame, range_us: int, step_us: int) -> DataFrame:
    """Rates at the instants ``_j`` to ``_last`` of every row: its samples' number, first and last time, increase,
    and the part of the increase that is the first sample's (not counted where that is the first in range).
    Keeps the columns that are not named so.

    Rows are not copied to their instants: each goes to its block of instants (once more to the next one if
    it reaches into it), and the instants up to the next row of the block are computed from the rows at most
    ``range`` back. So a block holds each of its rows once, and what is sorted grows with the rows.
    """
    reach = -(-range_us // step_us)  # instants that a row is in range of, at most
    width = max(1024, 8 * reach)
    b = F.floor(F.col("_j") / F.lit(width)).cast("long")
    blocks = F.array(b, F.when(F.col("_last") >= (b + 1) * F.lit(width), b + 1))
    e = (e.filter("_j IS NOT NULL").withColumn("_blk", F.explode(F.filter(blocks, lambda x: x.isNotNull())))
          .repartition("name", "_sid", "_blk"))
    w = Window.partitionBy("name", "_sid", "_blk").orderBy("_t0")
    parts = ["_t0", "_t1", "_last", "_n", "_s", "_i0"]
    keep = [c for c in e.columns if c not in (*parts, "_j", "_blk")]
    # a step of slack: which of the rows are in range of an instant is told by _last
    e = e.select(*keep, "_blk", "_j", "_last", F.lead("_j").over(w).alias("_next"),
                 F.collect_list(F.struct(*parts)).over(w.rangeBetween(-(range_us + step_us), 0)).alias("_rows"))
    lo = F.greatest(F.col("_j"), F.col("_blk") * F.lit(width))
    hi = F.least(F.col("_last"), (F.col("_blk") + 1) * F.lit(width) - 1, F.col("_next") - 1)
    at = F.transform(F.when(lo <= hi, F.sequence(lo, hi)), lambda k: F.struct(
        k.alias("k"), F.filter("_rows", lambda r: r["_last"] >= k).alias("r")))
    at = F.transform(at, lambda x: F.struct(
        x["k"].alias("k"), F.get(x["r"], F.lit(0)).alias("a"), F.element_at(x["r"], -1)["_t1"].alias("t1"),
        F.aggregate(x["r"], F.lit(0).cast("long"), lambda n, r: n + r["_n"]).alias("n"),
        F.aggregate(x["r"], F.lit(None).cast("double"), lambda s, r: F.coalesce(s + r["_s"], s, r["_s"])).alias("s")))
    at = F.filter(at, lambda x: (x["n"] >= 2) & (x["t1"] > x["a"]["_t0"]))
    x = F.col("_x")
    rate = (x["s"] - x["a"]["_i0"]) / ((x["t1"] - x["a"]["_t0"]) / F.lit(1e6))
    return (e.select(*keep, F.explode(at).alias("_x"))
             .select(*keep, F.timestamp_micros(x["k"] * F.lit(step_us)).alias("ts"), rate.alias("value")))


def rate_from_panes(panes: DataFrame, range_s: int, step_s: int, labels: str = "labels") -> DataFrame:
    """:func:`counter_rate` from one row per series and step, ``(name, sid, labels, pane, n, t0, t1, v0, v1,
    inc)``: pane number (its end is ``pane * step``), samples, times (us) and values of the first and last,
    increase between them. The range must be a multiple of the step. The increase
    from one pane to the next is that of the later one's first sample."""
    if range_s % step_s:
        raise ValueError("the range must be a multiple of the step")
    d = previous(panes.withColumnRenamed("sid", "_sid"), ["name", "_sid"], ["pane"], None, ["v1"], "_prev")
    i0 = F.when(F.col("v1_prev").isNull(), F.lit(0.0)).when(F.col("v0") < F.col("v1_prev"), F.col("v0")).otherwise(F.col("v0") - F.col("v1_prev"))
    e = d.select("name", "_sid", labels, F.col("pane").alias("_j"), (F.col("pane") + F.lit(range_s // step_s - 1)).alias("_last"),
                 F.col("n").alias("_n"), F.col("t0").alias("_t0"), F.col("t1").alias("_t1"),
                 (F.col("inc") + i0).alias("_s"), i0.alias("_i0"))
    return _rates(e, range_s * 1_000_000, step_s * 1_000_000).select("name", labels, "ts", "value")


def counter_rate_at_samples(df: DataFrame, range_s: int, labels: str = "labels",
                            chunk_us: int | None = None) -> DataFrame:
    """Counter rate at every sample time ``t`` over ``(t - range, t]`` (W9 as
    a range frame): same reset handling as :func:`counter_rate`.

    The range window runs on time blocks of each series with the last
    ``range`` of every block copied into the next one, so each frame is
    complete without a whole series in one task.
    """
    range_us = range_s * 1_000_000
    d = df.withColumn("_sid", series_key(labels))
    d = previous(d, ["name", "_sid"], ["ts"], chunk_of("ts", chunk_us), ["value"], "_prev")
    d = d.withColumn("_inc", F.when(F.col("value_prev").isNull(), F.lit(0.0))
                     .when(F.col("value") < F.col("value_prev"), F.col("value"))
                     .otherwise(F.col("value") - F.col("value_prev")))
    b = time_blocks(d, ["name", "_sid"], "ts", before_us=range_us, after_us=0,
                    width_us=range_us).repartition("name", "_sid", "_blk")
    w = Window.partitionBy("name", "_sid", "_blk").orderBy("_us").rangeBetween(-(range_us - 1), 0)
    b = b.select("*", F.count(F.lit(1)).over(w).alias("_n"), F.min("_us").over(w).alias("_t0"),
                 F.sum("_inc").over(w).alias("_s"), F.first("_inc").over(w).alias("_i0"))
    rate = (F.col("_s") - F.col("_i0")) / ((F.col("_us") - F.col("_t0")) / F.lit(1e6))
    return (b.filter("_core AND _n >= 2 AND _us > _t0")
             .select("name", labels, "ts", rate.alias("value")))


def sum_by(df: DataFrame, by, labels: str = "labels", scale: float = 1.0) -> DataFrame:
    """``sum(...) by (label)`` at every instant (A13), times ``scale``."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy("ts", *[label(k, labels).alias(k) for k in by]).agg(
        (F.sum("value") * F.lit(scale)).alias("value"))


def instant_values(df: DataFrame, step_s: int, lookback_s: int = 300, labels: str = "labels") -> DataFrame:
    """Gauge value of every series at each step instant: the latest sample
    within the look-back (instant-vector selection), ``name, labels, ts, value``."""
    step_us, back_us = step_s * 1_000_000, lookback_s * 1_000_000
    k0 = F.expr(f"(unix_micros(ts) + {step_us - 1}) div {step_us}")
    k1 = F.expr(f"(unix_micros(ts) + {back_us}) div {step_us}")
    e = df.select("name", series_key(labels).alias("_sid"), labels, epoch_us("ts").alias("_us"), "value",
                  F.explode(F.sequence(k0, k1)).alias("_k"))
    e = e.filter(F.col("_k") * F.lit(step_us) <= F.col("_us") + F.lit(back_us))
    g = e.groupBy("name", "_sid", "_k").agg(F.first(labels).alias(labels),
                                            F.max_by("value", "_us").alias("value"))
    return g.select("name", labels, F.timestamp_micros(F.col("_k") * F.lit(step_us)).alias("ts"), "value")


def latest(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Latest sample of every series (G1/G5): ``name, labels, ts, value``."""
    g = df.groupBy("name", series_key(labels).alias("_sid")).agg(
        F.first(labels).alias(labels), F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
    return g.drop("_sid")


def label_values(df: DataFrame, key: str, name_regex: str | None = None, matchers=(),
                 labels: str = "labels") -> DataFrame:
    """Distinct values of one label over the matching series."""
    m = match_labels(df, list(matchers), name_regex=name_regex, labels=labels)
    return m.select(label(key, labels).alias(key)).filter(F.col(key) != "").distinct()


def age_days(df: DataFrame, now_s: float, digits: int | None = 1) -> DataFrame:
    """``(time() - v) / 86400`` per sample (F14), rounded to ``digits`` for
    display (``None`` keeps full precision)."""
    v = (F.lit(float(now_s)) - F.col("value")) / F.lit(86400.0)
    return df.withColumn("value", v if digits is None else F.round(v, digits))


def info_table(df: DataFrame, rename: dict, labels: str = "labels") -> DataFrame:
    """Flatten chosen labels into renamed columns."""
    return df.select(*[label(k, labels).alias(v) for k, v in rename.items()], "ts", "value")


def recent(df: DataFrame, now, minutes: int = 15) -> DataFrame:
    """Samples in the last ``minutes`` before ``now``."""
    end = F.lit(now).cast("timestamp")
    return df.filter((F.col("ts") > end - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("ts") <= end))


def to_samples(df: DataFrame, ts: str, metrics: dict, labels: dict | None = None) -> DataFrame:
    """Gauge rows ``(name, labels, ts, value)`` from metric columns (S10):
    ``metrics`` maps gauge name -> column."""
    lab = F.create_map(*[x for k, v in (labels or {}).items() for x in (F.lit(k), F.lit(v))]) if labels \
        else F.create_map().cast("map<string,string>")
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value"))
                     for n, c in metrics.items()])
    return df.select(F.col(ts).alias("ts"), F.explode(rows).alias("_g")).select(
        F.col("_g.name").alias("name"), lab.alias("labels"), "ts", F.col("_g.value").alias("value"))
