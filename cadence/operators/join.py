"""Joins of two sides that both repeat their keys.

A key that holds a third of both sides makes a third times a third of all pairs,
and a plain shuffle join forms them in one task: adaptive execution can split one
side, not both. Here rows of frequent keys are numbered, cut into blocks of
counted rows, and every block of one side meets every block of the other in a
partition of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.blocks import materialize, row_index

#: Rows of a key on either side from which it is cut into blocks of as many.
BLOCK_ROWS = 100_000


def _blocked(side: DataFrame, hot: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
    """Rows of the frequent keys, each with its block (in place of the number of blocks ``own``), once for
    every block of the other side (in place of ``other``)."""
    d = row_index(side.join(hot, keys), keys, ["_id"], None, "_rn")
    d = d.withColumn(own, F.pmod(F.col("_rn") - 1, F.col(own)))
    return d.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("_rn", "_id")


def salted_join(left: DataFrame, right: DataFrame, keys, rows: int = BLOCK_ROWS) -> DataFrame:
    """Inner join on ``keys``, many rows to many, with bounded tasks.

    Keys with more than ``rows`` rows on a side are joined block by block: no
    partition gets more than about ``rows`` rows of a key from either side, however
    many rows, equal ones included, the key has. The others take a plain join. Both
    sides are written once, as they are read for the counts and for both joins. Null
    keys match nothing; columns other than the keys must not share names."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    left, right = (materialize(d.dropna("any", subset=keys).withColumn("_id", F.monotonically_increasing_id())) for d in (left, right))
    n = [d.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).alias(c)) for d, c in ((left, "_nl"), (right, "_nr"))]
    hot = materialize(n[0].join(n[1], keys).where("_nl > 1 or _nr > 1"))
    cold = left.drop("_id").join(hot, keys, "left_anti").join(right.drop("_id").join(hot, keys, "left_anti"), keys)
    blocks = _blocked(left, hot, keys, "_nl", "_nr").join(_blocked(right, hot, keys, "_nr", "_nl"), [*keys, "_nl", "_nr"])
    return cold.unionByName(blocks.drop("_nl", "_nr"))
