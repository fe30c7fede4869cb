"""Many-to-many joins of skewed sides, and shards of a whole table."""

import collections

import pytest
from pyspark.sql import functions as F

from cadence.operators.clean import clean_minutes
from cadence.operators.join import salted_join
from cadence.operators.split import shards_global
from cadence.sources.sinks import write_table


def _sides(spark, n=3000):
    """A third of both sides in one key, some keys on one side only, nulls, equal rows."""
    a = [(1 if i % 3 == 0 else i % 50, "k", i % 7) for i in range(n)] + [(None, "k", 1), (777, "k", 2), (5, None, 3)]
    b = [(1 if i % 3 == 0 else i % 40, "k", float(i % 5)) for i in range(n // 10)] + [(None, "k", 1.0), (888, "k", 2.0)]
    return spark.createDataFrame(a, "x int, y string, u int"), spark.createDataFrame(b, "x int, y string, v double")


@pytest.mark.parametrize("rows", [100_000, 100, 7])
def test_salted_join_equals_plain_join(spark, rows):
    a, b = _sides(spark)
    got = collections.Counter(map(tuple, salted_join(a, b, ["x", "y"], rows).select("x", "y", "u", "v").collect()))
    assert got == collections.Counter(map(tuple, a.join(b, ["x", "y"]).select("x", "y", "u", "v").collect()))
    assert salted_join(a.limit(0), b, ["x", "y"], rows).count() == 0


def test_hot_key_is_spread(spark):
    """No partition of the join makes more than a few blocks' pairs of the frequent key, though all its rows are equal."""
    a = spark.range(4000).select(F.lit(1).alias("x"), F.lit(2).alias("u"))
    b = spark.range(400).select(F.lit(1).alias("x"), F.lit(3).alias("v"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("64", "false", "-1"), strict=True):
            spark.conf.set(k, v)
        per = [r["n"] for r in salted_join(a, b, "x", 100).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(per) == 1_600_000 and len(per) > 32 and max(per) <= 12 * 100 * 100


def test_clean_minutes(spark):
    dur = spark.createDataFrame([("o", "a", "f1", 1.0), ("o", "a", "f2", 2.0), ("o", "b", "f1", 3.0)], "HashOwner string, HashApp string, HashFunction string, d double")
    mem = spark.createDataFrame([("o", "a", 9.0)], "HashOwner string, HashApp string, m double")
    func = spark.createDataFrame([("o", "a", "f1", "http.x", 0, 2, None), ("o", "a", "f2", "timer", 1, 0, 0), ("o", "b", "f1", "timer", 1, 1, 1)],
                                 "HashOwner string, HashApp string, HashFunction string, Trigger string, m1 int, m2 int, m3 int")
    out = clean_minutes(dur, mem, func, ["HashOwner", "HashApp"], "HashFunction", "Trigger", ["m1", "m2", "m3"], rows=1)
    got = sorted((r["HashFunction"], r["d"], r["m"], r["Trigger_http_x"], r["Trigger_timer"], r["minute"], r["invocations"]) for r in out.collect())
    assert got == [(f, d, 9.0, *x) for f, d in (("f1", 1.0), ("f2", 2.0)) for x in ((0, 1, "m1", 1), (1, 0, "m2", 2), (1, 0, "m3", None))]


def test_shards_of_a_table(spark, tmp_path):
    """The numbering of ntile; a shard is read alone, by its partition."""
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("t"), F.lit("x").alias("v"))
    write_table(shards_global(df, "t", 7), f"{tmp_path}/shards", ["shard"])
    back = spark.read.parquet(f"{tmp_path}/shards")
    got = {r["t"]: r["shard"] for r in back.collect()}
    sizes = [15, 15, 14, 14, 14, 14, 14]
    assert got == {t: s + 1 for s, size in enumerate(sizes) for t in range(sum(sizes[:s]), sum(sizes[:s]) + size)}
    one = back.where("shard = 3")
    assert one.count() == 14 and "PartitionFilters: [isnotnull(shard" in one._jdf.queryExecution().executedPlan().toString()
