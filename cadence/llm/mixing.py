"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``target / size of its source`` times. The
whole part is taken as it is; the fractional parts are rounded in pairs: mass
(probability times size) moves from one document of a pair to the other, in a
random direction that keeps both expectations, until one is integral. The other
goes on to the next pair. Longer documents are paired first, so that what stays
open is short. Each bucket of a source leaves at most one open document; the open
ones meet in a reduction tree, until one is left for each source, and that is
rounded alone. Where that misses a target by much (one document may be longer than
the target), the gap is rounded in the same way over the documents that fit in it,
as copies more or less, until no such document is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import dealt, saved, whole_groups

#: Weights of the sources in order, repeating; the most copies of a document.
WEIGHTS, MOST_COPIES, SEED = (1, 2, 3), 3.0, 7
#: Documents of a bucket, buckets joined by one node of the tree, and the share of
#: its target by which a source may miss it.
BUCKET_ROWS, FAN_IN, NEAR = 512, 64, 0.005
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``sizes`` (source, source_size; other columns stay) with ``target``: the sources in code point order, null last, weigh ``weights`` in turn and share the sum of
    all sizes; a target stops at ``most`` times its source's size and the excess is
    reshared by weight until none is above.

    A share is ``level * weight``. Each round is one sum over the sources not yet
    stopped; the rounds end when no further source stops. Positions come from a
    count per range of source names, so no task sorts all sources."""
    sizes = saved(sizes, "sources")
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    s = saved(positions(sizes, "source").withColumn("weight", weigh), "sources")
    level, stopped = 0.0, -1
    while True:
        capped = F.col("source_size") * most < F.col("weight") * level
        row = s.agg(F.sum(F.col("source_size").cast("double")), F.sum(F.when(capped, F.col("source_size") * most)),
                    F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, True))).first()
        if row[3] == stopped or not row[2]:
            break
        level, stopped = ((row[0] or 0.0) - (row[1] or 0.0)) / row[2], row[3]
    return s.select(*sizes.columns,
                    F.least(F.col("weight") * level, F.col("source_size") * most).alias("target"))


def positions(df: DataFrame, name: str) -> DataFrame:
    """``df`` (a row per value of ``name``) with ``at``, the 0-based position of the
    row in code point order, nulls last: rows are ranked in ranges, and a range
    starts where the counts of those before it end."""
    order = [F.col(name).isNull(), F.col(name)]
    d = saved(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = d.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return d.join(starts, "part").withColumn("at", F.col("start") + rank - 1).drop("part", "start")


def settled(p: float, w: float, p2: float, w2: float, u: float) -> tuple[float, float]:
    """Two probabilities after mass moved between them, one of them 0 or 1. The
    weighted sum is kept, and so is the expectation of each over a uniform ``u``."""
    up, down = min(w * (1 - p), w2 * p2), min(w * p, w2 * (1 - p2))
    if u * (up + down) < down:
        return (1.0 if up == w * (1 - p) else min(1.0, p + up / w)), (0.0 if up == w2 * p2 else max(0.0, p2 - up / w2))
    return (0.0 if down == w * p else max(0.0, p - down / w)), (1.0 if down == w2 * (1 - p2) else min(1.0, p2 + down / w2))


OPEN = -1
ITEM = "source string, doc_id long, text_key long, size long, times long, whole int, p double, dice long, bucket long, buckets long, sign int, extra int"


def _round(level: int, last: bool):
    """Pairs the open items of each bucket in order; what stays open of each pair
    meets the next. ``extra`` becomes 0 or 1, or OPEN for the item that
    is left; at the ``last`` level that one is rounded to the nearer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            p, w = t["p"].to_numpy().copy(), (t["size"].to_numpy() * t["times"].to_numpy()).astype(float)
            dice = t["dice"].to_numpy().view(np.uint64)
            u = np.array([xxhash.xxh3_64_intdigest(int(d).to_bytes(8, "little"), seed=level) for d in dice], np.float64) / 2.0**64
            where = list(zip(t["key"].to_numpy().tolist(), t["source"].to_pylist(), strict=True))
            extra = np.where(p >= 1, 1, np.where(p > 0, OPEN, 0)).astype(np.int32)
            alone = (w == 0) & (extra == OPEN)  # without words: nothing to keep in balance
            extra[alone] = u[alone] < p[alone]
            waiting: dict = {}
            for i in np.flatnonzero(extra == OPEN).tolist():
                j = waiting.pop(where[i], None)
                if j is None:
                    waiting[where[i]] = i
                    continue
                p[j], p[i] = settled(p[j], w[j], p[i], w[i], u[i])
                for k in (j, i):
                    if p[k] in (0.0, 1.0):
                        extra[k] = int(p[k])
                    else:
                        waiting[where[i]] = k
            if last:
                left = np.fromiter(waiting.values(), np.int64, len(waiting))
                extra[left] = p[left] >= 0.5
            t = t.set_column(t.schema.get_field_index("p"), "p", pa.array(p))
            t = t.set_column(t.schema.get_field_index("extra"), "extra", pa.array(extra, pa.int32()))
            yield from t.drop_columns(["key", "shorter"]).combine_chunks().to_batches()
    return run


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document: (doc_id, source, text_key, size, times,
    source_size, target, copies), a row per distinct (doc_id, source, text).

    ``size`` is the number of words (null text: 0), ``times`` how many such rows
    there are: repeated rows share one number of copies, and each of them is taken
    so often. No document is taken more than ``most`` times. Null sources are one
    source, the last. Draws depend on the rows and the seed alone, so reruns agree
    whatever the partitioning. An empty table gives no rows.

    A source has as many buckets as its rows ask for, so one with most of the rows
    is spread over many."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"),
                    F.xxhash64("text").alias("text_key"))
    items = saved(d.groupBy("doc_id", "source", "text_key", "size").agg(F.count(F.lit(1)).alias("times")), "items")
    words = F.col("size") * F.col("times")
    sizes = items.groupBy("source").agg(F.sum(words).alias("source_size"), F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).alias("buckets"))
    wanted = saved(targets(sizes, weights, most), "targets")
    buckets = wanted.agg(F.max("buckets")).first()[0] or 1
    dice = F.xxhash64(F.lit(seed), "doc_id", "text_key", "source")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    todo = _of_source(items, wanted).withColumns({"dice": dice, "whole": F.floor(share).cast("int"), "p": share - F.floor(share),
                                                  "sign": F.lit(1)})
    level = 0
    while True:
        now, level = _rounded(todo, buckets, level)
        now = now.withColumn("whole", F.col("whole") + F.col("sign") * F.col("extra"))
        taken = now.groupBy("source").agg(F.sum(F.col("whole") * words).alias("taken"))
        gaps = saved(taken.alias("t").join(wanted.alias("w"), F.col("t.source").eqNullSafe(F.col("w.source")))
                     .select("w.*", (F.col("target") - F.col("taken")).alias("gap"), (F.abs(F.col("target") - F.col("taken")) > NEAR * F.col("target")).alias("far")), "gaps")
        room = F.when(F.col("far") & (F.col("size") > 0) & (words <= F.abs("gap"))
                      & F.when(F.col("gap") > 0, F.col("whole") + 1 <= most).otherwise(F.col("whole") > 0), words).otherwise(0)
        now = _of_source(now.drop("bucket", "buckets", "p", "sign", "extra"), gaps).withColumn("room", room)
        rooms = saved(now.groupBy("source").agg(F.sum("room").alias("all_room")), "room")
        if not rooms.where("all_room > 0").head(1):
            break
        now = now.alias("n").join(rooms.alias("r"), F.col("n.source").eqNullSafe(F.col("r.source"))).select("n.*", "all_room")
        todo = now.withColumns({"p": F.when(F.col("room") > 0, F.least(F.lit(1.0), F.abs("gap") / F.col("all_room"))).otherwise(0.0),
                                "sign": F.when(F.col("gap") > 0, 1).otherwise(-1)})
    return now.select("doc_id", "source", "text_key", "size", "times", "source_size", "target", F.col("whole").alias("copies"))


def _of_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items with the columns of their source, null being one."""
    return items.alias("i").join(sources.alias("w"), F.col("i.source").eqNullSafe(F.col("w.source"))).select(
        "i.*", *[f"w.{c}" for c in sources.columns if c not in items.columns])


def _rounded(todo: DataFrame, buckets: int, level: int) -> tuple[DataFrame, int]:
    """All items with ``extra`` 0 or 1, from the levels of the tree, and the next unused level."""
    names = [c.split()[0] for c in ITEM.split(", ")]
    todo = todo.withColumns({"bucket": F.pmod(F.xxhash64("dice"), F.col("buckets")), "extra": F.lit(OPEN)})
    done = None
    while True:
        last = buckets == 1
        todo = todo.select(*names, F.xxhash64("source", "bucket").alias("key"), (-F.col("size") * F.col("times")).alias("shorter"))
        step = saved(dealt(todo, "shorter", "dice", "doc_id", "text_key").mapInArrow(_round(level, last), ITEM), "rounds")
        ready, level = step.where(F.col("extra") != OPEN), level + 1
        done = ready if done is None else done.union(ready)
        if last:
            return done, level
        buckets = -(-buckets // FAN_IN)
        todo = step.where(F.col("extra") == OPEN).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))


def mix(docs: DataFrame, **kwargs) -> DataFrame:
    """The rows of ``docs`` (all its columns, whatever their names), each as often as
    :func:`copies` says; an empty table stays empty."""
    taken = copies(docs, **kwargs).where("copies > 0")
    same = (F.col("d.doc_id").cast("long").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source"))
            & (F.xxhash64("d.text") == F.col("t.text_key")))
    return (docs.alias("d").join(taken.alias("t"), same)
            .select("d.*", F.explode(F.array_repeat(F.lit(1), F.col("t.copies"))).alias("__mix_copy")).drop("__mix_copy"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the mix of all ``documents``."""
    c = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = c.withColumn("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
