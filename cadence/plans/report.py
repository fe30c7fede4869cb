"""Presentation edge of a registered query: fixed decimals, zone-less time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DataType, DoubleType, FloatType, TimestampNTZType,
                               TimestampType)

#: Significant digits of a reported number, and digits it is snapped to before (so that
#: an exact half is one in any engine).
DIGITS, SNAP = 9, 12
#: Numbers are scaled by two powers of ten up to 10 ** 22, which doubles hold exactly. That reaches
#: from TINY (what is smaller counts as 0) to HUGE (what is larger stays as it is).
EXACT, TINY, HUGE = 22.0, 1e-30, 1e50


def _exponent(c: Column, n: int) -> Column:
    """The power of ten that makes ``n`` digits of a number whole."""
    return F.lit(n - 1.0) - F.floor(F.log10(F.greatest(F.abs(c), F.lit(TINY)))).cast("double")


def _rounded(c: Column, e: Column, s1: Column, s2: Column) -> Column:
    """Half up at 10 ** -e (``s1 * s2``: 10 ** |e|), in plain double arithmetic (another
    engine doing the same steps gets the same value); infinite and not a number as they are."""
    up = (F.when(e >= 0, F.floor(c * s1 * s2 + 0.5).cast("double") / s2 / s1)
           .otherwise(F.floor(c / s1 / s2 + 0.5).cast("double") * s2 * s1))
    return F.when(F.abs(c) < TINY, F.lit(0.0)).when(F.abs(c) < HUGE, up).otherwise(c)


def _powers(e: Column) -> tuple[Column, Column]:
    """Two exact powers of ten, whose product is 10 ** |e|; the second is 1 for nearly all numbers."""
    ten, size = F.lit(10.0), F.abs(e)
    return (F.pow(ten, F.least(size, F.lit(EXACT))).alias("s1"),
            F.when(size <= EXACT, F.lit(1.0)).otherwise(F.pow(ten, F.least(size - EXACT, F.lit(EXACT)))).alias("s2"))


def _all_fixed(df: DataFrame, names: list[str]) -> DataFrame:
    """Both roundings of columns: every step a projection of its own, so that what a
    step names several times is computed once."""
    if not names:
        return df
    for n in (SNAP, DIGITS):
        df = df.withColumns({f"__e_{c}": _exponent(F.col(f"`{c}`"), n) for c in names})
        df = df.withColumns({f"__s{i}_{c}": _powers(F.col(f"`__e_{c}`"))[i] for c in names for i in (0, 1)})
        df = df.withColumns({c: _rounded(*[F.col(f"`{p}{c}`") for p in ("", "__e_", "__s0_", "__s1_")]) for c in names})
    return df


def _fixed_items(c: Column) -> Column:
    """Both roundings of the items of an array, in the same steps."""
    for n in (SNAP, DIGITS):
        c = F.transform(c, lambda x: F.struct(x.alias("x"), _exponent(x, n).alias("e")))  # noqa: B023  called at once
        c = F.transform(c, lambda t: F.struct(t["x"].alias("x"), t["e"].alias("e"), *_powers(t["e"])))
        c = F.transform(c, lambda t: _rounded(t["x"], t["e"], t["s1"], t["s2"]))
    return c


def _fix(c: Column, dt: DataType) -> tuple[Column, bool]:
    if isinstance(dt, TimestampType):
        return c.cast(TimestampNTZType()), True
    if isinstance(dt, ArrayType) and isinstance(dt.elementType, (DoubleType, FloatType)):
        return _fixed_items(F.transform(c, lambda x: x.cast("double"))), True
    if isinstance(dt, ArrayType) and isinstance(dt.elementType, (TimestampType, TimestampNTZType)):
        return F.transform(c, lambda x: F.unix_micros(x.cast(TimestampType()))), True
    if isinstance(dt, ArrayType):
        _, changed = _fix(F.lit(None), dt.elementType)  # does the element type need it?
        if changed:
            return F.transform(c, lambda x: _fix(x, dt.elementType)[0]), True
    return c, False


def report(df: DataFrame) -> DataFrame:
    """Round floating columns (also inside arrays) to DIGITS significant digits,
    whatever their magnitude, and print instants as UTC wall clock (in arrays:
    microseconds since 1970), so results compare across engines."""
    cols, doubles = [], []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            doubles.append(f.name)
            cols.append(c.cast("double").alias(f.name))
        else:
            cols.append(_fix(c, f.dataType)[0].alias(f.name))
    return _all_fixed(df.select(*cols), doubles).select(*[F.col(f"`{c}`") for c in df.columns])
