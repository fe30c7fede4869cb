"""Per-series ordered computations that never put one whole series in one task.

A plain ``Window.partitionBy(series)`` sends every row of a series to one task;
if one series holds a third of the data, that task holds a third of the data.
The helpers here split each series into *chunks* (a key that is monotone in the
series order, e.g. the day of the timestamp) and work per ``(series, chunk)``:

* cumulative quantities (row number, running sum, previous row) are computed
  inside the chunk and corrected by a carry taken from a small per-chunk
  summary table (one row per chunk, so ``#rows / chunk size`` rows);
* bounded frames (``rowsBetween(-a, b)``, ``rangeBetween(-a, b)``) are made
  exact by copying the ``a``/``b`` boundary rows of each block into the
  neighbouring block ("halo") and keeping only the block's own rows after.

Unless the caller gives a chunk key, rows are cut by counted rows: they are range
partitioned by (series, order) and written once with the number of their range
(:func:`ranged`), so a burst of one series is cut as finely as its rows ask for
(down to the tiebreak in ``order``), and sparse series share a range. Rows are
then hashed on the full ``(series, chunk)`` / ``(series, block)`` key before the
windows run. Null series and null stamps are keys like any other (nulls first).
All of it is plain DataFrame code: groupBy, join, window, explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.time import epoch_us

DAY_US = 86_400 * 1_000_000


def _cols(xs) -> list:
    if xs is None:
        return []
    if isinstance(xs, (str, Column)):
        return [xs]
    return list(xs)


def time_chunk(ts: str, width_us: int = DAY_US) -> Column:
    """Chunk key monotone in ``ts``: index of the ``width_us`` slot."""
    return F.floor(epoch_us(ts) / F.lit(width_us)).cast("long")


def chunk_of(ts: str, chunk_us: int | None) -> Column | None:
    """:func:`time_chunk` of a given width; None (chunks by counted rows) without one."""
    return time_chunk(ts, chunk_us) if chunk_us else None


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared checkpoint folder
    (``spark.checkpoint.dir``) and read it back.

    Used where one intermediate feeds several consumers (a per-chunk summary
    and the rows it is joined back to): without it Spark recomputes the whole
    upstream for each consumer, and chained helpers would multiply that work.
    A table (unlike an RDD checkpoint) keeps column pruning, filter pushdown and
    real size statistics for adaptive execution, and it survives executor loss.
    """
    from cadence.session import written_path
    path = written_path(df.sparkSession, "table")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, series, order) -> DataFrame:
    """``df`` written once with ``_ck``, the number of the range of (series, order)
    that a row falls in. Ranges hold about equally many rows whatever the series;
    rows that agree in all of (series, order) stay together."""
    keys = [F.col(c) if isinstance(c, str) else c for c in [*series, *order]]
    return materialize(df.repartitionByRange(*keys).withColumn("_ck", F.spark_partition_id()))


def _chunked(df: DataFrame, series, order, chunk: Column | None) -> DataFrame:
    return ranged(df, series, order) if chunk is None else df.withColumn("_ck", chunk)


def _by_chunk(d: DataFrame, series) -> DataFrame:
    """Rows hashed on the full (series, chunk) key.

    Spark accepts input hashed on a *subset* of a window's partition keys, so
    rows that arrive hashed on ``series`` alone (after a join or aggregate on
    it) would keep a hot series in one task; the explicit repartition rules
    that out, and costs nothing extra when a shuffle was needed anyway.
    """
    return d.repartition(*series, "_ck")


def _carry(d: DataFrame, series, summary: dict, carry: dict) -> DataFrame:
    """Per-(series, chunk) table of values carried over from other chunks:
    ``summary`` aggregates each chunk (partial aggregation, one row per chunk),
    ``carry`` combines them with windows over the chunk order of a series."""
    summ = d.groupBy(*series, "_ck").agg(*[v.alias(k) for k, v in summary.items()])
    return summ.select(*series, "_ck", *[v.alias(k) for k, v in carry.items()])


def _with(d: DataFrame, summ: DataFrame, series) -> DataFrame:
    """Rows with the carried values of their chunk; null keys match null keys."""
    keys = [*series, "_ck"]
    summ = summ.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    cond = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]
    return d.join(summ, cond, "inner").drop(*[f"_r{i}" for i in range(len(keys))])


def row_index(df: DataFrame, series, order, chunk: Column | None = None, name: str = "rn",
              total: str | None = None) -> DataFrame:
    """1-based position of each row in its series, by ``order``; with
    ``total``, also the series' row count (taken from the same per-chunk
    summary, so no second pass over the rows).

    ``chunk`` must be non-decreasing in ``order`` (e.g. ``time_chunk(ts)``
    when ``ts`` leads the order).
    """
    series, order = _cols(series), _cols(order)
    df = _chunked(df, series, order, chunk)
    w = Window.partitionBy(*series, "_ck").orderBy(*order)
    d = _by_chunk(df, series).withColumn("_rin", F.row_number().over(w))
    earlier = Window.partitionBy(*series).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    carry = {"_off": F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("long")}
    if total:
        carry[total] = F.sum("_n").over(Window.partitionBy(*series)).cast("long")
    summ = _carry(df, series, {"_n": F.count(F.lit(1))}, carry)
    out = _with(d, summ, series)
    return out.withColumn(name, F.col("_rin") + F.col("_off")).drop("_ck", "_off", "_rin")


def running_sum(df: DataFrame, series, order, chunk: Column | None, value: str, name: str) -> DataFrame:
    """Cumulative sum of ``value`` along the series (nulls skipped). The sum of the chunks before
    enters a chunk as a row before its first, so rows are not joined to it."""
    series, order = _cols(series), _cols(order)
    df = _chunked(df, series, order, chunk)
    earlier = Window.partitionBy(*series).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    summ = _carry(df, series, {"_s": F.sum(value)},
                  {"_carry": F.sum("_s").over(earlier)})  # null while no value seen yet
    rows = df.select("*", F.lit(True).alias("_own"))
    d = _by_chunk(rows.unionByName(summ.filter("_carry IS NOT NULL"), allowMissingColumns=True), series)
    w = Window.partitionBy(*series, "_ck").orderBy("_own", *order).rowsBetween(Window.unboundedPreceding, 0)
    out = d.select(*df.columns, "_own", F.sum(value).over(w).alias("_in"), F.first("_carry").over(w).alias("_before")).filter("_own")
    total = (F.when(F.col("_in").isNull() & F.col("_before").isNull(), F.lit(None))
              .otherwise(F.coalesce(F.col("_in"), F.lit(0)) + F.coalesce(F.col("_before"), F.lit(0))))
    return out.withColumn(name, total).drop("_ck", "_before", "_in", "_own")


def _key(order) -> Column:
    return F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])


def _order_value(df: DataFrame, order) -> Column:
    """What :func:`_key` orders by, as a number where ``order`` is one column of whole numbers or stamps: a
    maximum by a number is aggregated by hash, one by a struct by a sort of all rows. Nulls come first."""
    kind = df.schema[order[0]].dataType.typeName() if len(order) == 1 and isinstance(order[0], str) else None
    if kind not in ("timestamp", "long", "integer"):
        return _key(order)
    v = F.unix_micros(order[0]) if kind == "timestamp" else F.col(order[0]).cast("long")
    return F.coalesce(v, F.lit(-2 ** 63))


def previous(df: DataFrame, series, order, chunk: Column | None, cols, suffix: str = "_prev",
             within=(), keep_chunk: bool = False) -> DataFrame:
    """``lag(c, 1)`` along the series for every ``c`` in ``cols``.

    The last values of the chunk before enter a chunk as a row before its first, so rows are not joined to
    them. ``within`` names columns that don't decrease along ``order``, such as a bin of it: rows are sorted by
    them first, and with ``keep_chunk`` (leaves ``_ck``) a window over ``(*series, "_ck", *within)`` needs no
    second sort."""
    series, order, cols, within = _cols(series), _cols(order), _cols(cols), _cols(within)
    df = _chunked(df, series, order, chunk)
    before = Window.partitionBy(*series).orderBy("_ck")
    value = {c: f"_v{i}" if c in (*series, *order, *within) else c for i, c in enumerate(cols)}
    summ = _carry(df, series, {f"_last{i}": F.max_by(F.col(c), _order_value(df, order)) for i, c in enumerate(cols)},
                  {"_later": F.lag(F.lit(True)).over(before), **{f"_l{i}": F.lag(f"_last{i}").over(before) for i in range(len(cols))}})
    # without stamps, so they are the first of their chunk; a series' first chunk, where rows without stamps are, has none
    ends = summ.filter("_later").select(*series, "_ck", *[F.col(f"_l{i}").alias(value[c]) for i, c in enumerate(cols)])
    rows = df.select("*", F.lit(True).alias("_own"), *[F.col(c).alias(v) for c, v in value.items() if v != c],
                     *[o.alias(f"_o{i}") for i, o in enumerate(order) if isinstance(o, Column)])
    d = _by_chunk(rows.unionByName(ends, allowMissingColumns=True), series)
    w = Window.partitionBy(*series, "_ck").orderBy(*within, *[f"_o{i}" if isinstance(o, Column) else o for i, o in enumerate(order)])
    d = d.select(*df.columns, "_own", *[F.lag(v).over(w).alias(f"{c}{suffix}") for c, v in value.items()])
    return d.filter("_own").drop("_own", *([] if keep_chunk else ["_ck"]))


def following(df: DataFrame, series, order, chunk: Column | None, cols, suffix: str = "_next") -> DataFrame:
    """``lead(c, 1)`` along the series for every ``c`` in ``cols``."""
    series, order, cols = _cols(series), _cols(order), _cols(cols)
    df = _chunked(df, series, order, chunk)
    w = Window.partitionBy(*series, "_ck").orderBy(*order)
    # the last-row flag comes from the same window as the leads, so ties in
    # the order cannot make them disagree
    d = _by_chunk(df, series).select(
        "*", F.lead(F.lit(1)).over(w).isNull().alias("_last"),
        *[F.lead(c).over(w).alias(f"_lead_{c}") for c in cols])
    after = Window.partitionBy(*series).orderBy("_ck")
    summ = _carry(df, series, {f"_first_{c}": F.min_by(F.col(c), _key(order)) for c in cols},
                  {f"_carry_{c}": F.lead(f"_first_{c}").over(after) for c in cols})
    out = _with(d, summ, series)
    out = out.select("*", *[F.when(F.col("_last"), F.col(f"_carry_{c}")).otherwise(F.col(f"_lead_{c}"))
                            .alias(f"{c}{suffix}") for c in cols])
    return out.drop("_ck", "_last", *[f"_carry_{c}" for c in cols], *[f"_lead_{c}" for c in cols])


def nearest_valid(df: DataFrame, series, order, chunk: Column | None, cols, stamp: str) -> DataFrame:
    """For every ``c`` in ``cols`` add ``c_prv`` / ``c_nxt``: ``struct(t, v)``
    of the last row at or before / the first row at or after the current one
    where ``c`` is not null (``t`` = value of ``stamp`` there). Both directions
    share one per-chunk summary. What it carries from other chunks enters a chunk
    as a row before its first and one after its last, so the rows with the found
    values, several times as wide, are not joined or shuffled again."""
    series, order, cols = _cols(series), _cols(order), _cols(cols)
    df = _chunked(df, series, order, chunk)
    key = _key(order)

    def val(c):
        return F.when(F.col(c).isNotNull(), F.struct(F.col(stamp).alias("t"), F.col(c).alias("v")))

    def keyed(c):
        return F.when(F.col(c).isNotNull(), key)

    before = Window.partitionBy(*series).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*series).orderBy(F.col("_ck").desc()).rowsBetween(Window.unboundedPreceding, -1)
    summary, carry = {}, {}
    for c in cols:
        summary[f"_l_{c}"] = F.max_by(val(c), keyed(c))
        summary[f"_f_{c}"] = F.min_by(val(c), keyed(c))
        carry[f"_cl_{c}"] = F.last(f"_l_{c}", ignorenulls=True).over(before)
        carry[f"_cf_{c}"] = F.last(f"_f_{c}", ignorenulls=True).over(after)
    summ = _carry(df, series, summary, carry)
    ends = F.array(*[F.struct(F.lit(pos).alias("pos"), *[F.col(f"{p}_{c}").alias(f"v{i}") for i, c in enumerate(cols)])
                     for pos, p in ((0, "_cl"), (2, "_cf"))])
    ends = summ.select(*series, "_ck", F.explode(ends).alias("_e")).select(
        *series, "_ck", F.col("_e.pos").alias("_pos"), *[F.col(f"_e.v{i}").alias(f"_v{i}") for i in range(len(cols))])
    rows = df.select("*", F.lit(1).alias("_pos"), *[o.alias(f"_o{i}") for i, o in enumerate(order) if isinstance(o, Column)])
    d = _by_chunk(rows.unionByName(ends, allowMissingColumns=True), series)
    d = d.withColumns({f"_v{i}": F.coalesce(val(c), F.col(f"_v{i}")) for i, c in enumerate(cols)})
    # both directions in one sort: the next value after a row is a lead that skips nulls, as frames
    # reaching to UNBOUNDED FOLLOWING are recomputed for every row
    names = ["_pos", *[f"_o{i}" if isinstance(o, Column) else o for i, o in enumerate(order)]]
    over = (f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in [*series, '_ck'])} "
            f"ORDER BY {', '.join(f'`{c}`' for c in names)}")
    grown = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    d = d.select(*df.columns, "_pos", *[F.col(f"_v{i}") for i in range(len(cols))],
                 *[F.expr(f"last(_v{i}, true) {over} {grown})").alias(f"{c}_prv") for i, c in enumerate(cols)],
                 *[F.expr(f"lead(_v{i}) IGNORE NULLS {over})").alias(f"_a{i}") for i in range(len(cols))])
    return d.filter("_pos = 1").select(*[c for c in df.columns if c != "_ck"], *[f"{c}_prv" for c in cols], *[
        F.coalesce(F.col(f"_v{i}"), F.col(f"_a{i}")).alias(f"{c}_nxt") for i, c in enumerate(cols)])


def row_blocks(df: DataFrame, series, rn: str, before: int, after: int,
               block: int | None = None) -> DataFrame:
    """Cut each series into blocks of ``block`` consecutive rows (by ``rn``).

    Every row appears once in its own block (``_core`` true) and, when it lies
    within ``after`` rows of a block start or ``before`` rows of a block end,
    once more in the neighbouring block (``_core`` false). A window
    ``partitionBy(*series, '_blk').orderBy(rn).rowsBetween(-before, after)``
    then sees complete frames for every core row.
    """
    series = _cols(series)
    if block is None:
        block = max(1024, 8 * (before + after + 1))
    if block < max(before, after, 1):
        raise ValueError("block must be at least as long as the frame reach")
    blk = F.floor((F.col(rn) - 1) / F.lit(block)).cast("long")
    pos = (F.col(rn) - 1) - blk * F.lit(block)
    entries = [F.struct(blk.alias("b"), F.lit(True).alias("core"))]
    if after > 0:
        entries.append(F.when(pos < after, F.struct((blk - 1).alias("b"), F.lit(False).alias("core"))))
    if before > 0:
        entries.append(F.when(pos >= block - before, F.struct((blk + 1).alias("b"), F.lit(False).alias("core"))))
    e = F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("_e")
    return (df.select("*", e)
              .select("*", F.col("_e.b").alias("_blk"), F.col("_e.core").alias("_core"))
              .drop("_e"))


def time_blocks(df: DataFrame, series, ts: str, before_us: int, after_us: int,
                width_us: int | None = None) -> DataFrame:
    """Time analogue of :func:`row_blocks` for ``rangeBetween`` frames on ``ts``.

    Adds ``_us`` (epoch micros), ``_blk`` and ``_core``; frames reaching at
    most ``before_us`` back / ``after_us`` ahead are complete for core rows.
    """
    series = _cols(series)
    if width_us is None:
        width_us = max(DAY_US, 4 * max(before_us, after_us))
    if width_us < max(before_us, after_us):
        raise ValueError("block width must cover the frame reach")
    us = epoch_us(ts)
    blk = F.floor(us / F.lit(width_us)).cast("long")
    off = us - blk * F.lit(width_us)
    entries = [F.struct(blk.alias("b"), F.lit(True).alias("core"))]
    if after_us > 0:
        entries.append(F.when(off < after_us, F.struct((blk - 1).alias("b"), F.lit(False).alias("core"))))
    if before_us > 0:
        entries.append(F.when(F.lit(width_us) - off <= before_us,
                              F.struct((blk + 1).alias("b"), F.lit(False).alias("core"))))
    e = F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("_e")
    return (df.select("*", us.alias("_us"), e)
              .select("*", F.col("_e.b").alias("_blk"), F.col("_e.core").alias("_core"))
              .drop("_e"))


def framed(df: DataFrame, series, rn: str, lo: int, hi: int, exprs: dict,
           block: int | None = None) -> DataFrame:
    """Evaluate ``exprs`` (name -> fn(window) -> Column) over the rows frame
    ``rowsBetween(lo, hi)`` along each series (ordered by ``rn``), block-parallel."""
    series = _cols(series)
    b = row_blocks(df, series, rn, max(0, -lo), max(0, hi), block).repartition(*series, "_blk")
    w = Window.partitionBy(*series, "_blk").orderBy(rn).rowsBetween(lo, hi)
    b = b.select("*", *[fn(w).alias(k) for k, fn in exprs.items()])
    return b.filter("_core").drop("_blk", "_core")
