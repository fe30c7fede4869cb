"""Sliding-window training sequences.

One ``collect_list(struct(...))`` per window keeps nulls in place (a
``collect_list`` of a bare column would skip them and shift the window). The
window runs on row blocks of each series with a halo of ``L+H-1`` rows, so a
long series is spread over many tasks and every window is still complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.blocks import chunk_of, framed, row_index


def _series(series):
    return [series] if isinstance(series, str) else list(series)


def _windows(df, series, ts, fields, length, tiebreak, chunk_us, block):
    s = _series(series)
    order = [ts] + ([tiebreak] if tiebreak else [])
    d = df.select(*s, *dict.fromkeys(order + list(fields)))
    d = row_index(d, s, order, chunk_of(ts, chunk_us), "_rn")
    rows = F.struct(*[F.col(f) for f in dict.fromkeys([ts] + list(fields))])
    w = framed(d, s, "_rn", 0, length - 1,
               {"_w": lambda win: F.collect_list(rows).over(win)}, block)
    return w.filter(F.size("_w") == length)


def _pick(arr: str, start: int, n: int, field: str) -> F.Column:
    return F.transform(F.slice(F.col(arr), start, n), lambda r: r[field])


def future_sequences(df: DataFrame, series, ts: str, inputs, targets, L: int = 7, H: int = 7,
                     tiebreak: str | None = None, drop_null_windows: bool = False,
                     chunk_us: int | None = None, block: int | None = None) -> DataFrame:
    """Inputs of rows ``i..i+L-1`` and targets of the *next* ``H`` rows.

    Columns: series keys, ``{ts}_seq``, ``{f}_seq`` per input, ``{ts}_target``,
    ``{f}_target`` per target; one row per full window (``n-L-H+1`` per series).
    """
    s = _series(series)
    w = _windows(df, s, ts, list(inputs) + list(targets), L + H, tiebreak, chunk_us, block)
    cols = [_pick("_w", 1, L, ts).alias(f"{ts}_seq")]
    cols += [_pick("_w", 1, L, f).alias(f"{f}_seq") for f in inputs]
    cols += [_pick("_w", L + 1, H, ts).alias(f"{ts}_target")]
    cols += [_pick("_w", L + 1, H, f).alias(f"{f}_target") for f in targets]
    out = w.select(*s, *cols)
    if drop_null_windows:
        out = out.filter(_no_nulls([f"{f}_seq" for f in inputs] + [f"{f}_target" for f in targets]))
    return out


def _no_nulls(cols) -> F.Column:
    c = F.lit(True)
    for a in cols:
        c = c & ~F.exists(a, lambda x: x.isNull())
    return c


def same_sequences(df: DataFrame, series, ts: str, inputs, targets, L: int = 7,
                   tiebreak: str | None = None, chunk_us: int | None = None,
                   block: int | None = None) -> DataFrame:
    """Inputs and targets of the *same* ``L`` rows (W4), stride 1, ``n-L+1``
    windows per series."""
    s = _series(series)
    w = _windows(df, s, ts, list(inputs) + list(targets), L, tiebreak, chunk_us, block)
    cols = [_pick("_w", 1, L, ts).alias(f"{ts}_seq")]
    cols += [_pick("_w", 1, L, f).alias(f"{f}_seq") for f in inputs]
    cols += [_pick("_w", 1, L, f).alias(f"{f}_target") for f in targets]
    return w.select(*s, *cols)


def stack_steps(df: DataFrame, cols, out: str = "x") -> DataFrame:
    """Per-feature arrays -> one ``steps x features`` matrix column."""
    z = F.arrays_zip(*[F.col(c) for c in cols])
    names = list(cols)
    return df.withColumn(out, F.transform(z, lambda r: F.array(*[r[n] for n in names])))


def first_of_sequence(df: DataFrame, cols, suffix: str = "_first") -> DataFrame:
    """First element of every sequence column ("most recent prediction", R9)."""
    return df.select("*", *[F.element_at(F.col(c), 1).alias(f"{c}{suffix}") for c in cols])


def xy_split(df: DataFrame, inputs, targets, keep=()) -> DataFrame:
    """Features / targets as two ``steps x features`` matrices ``x`` and ``y``
    (P13), next to the ``keep`` columns."""
    x = stack_steps(df, list(inputs), "x")
    return stack_steps(x, list(targets), "y").select(*keep, "x", "y")
