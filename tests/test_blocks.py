"""The chunked per-series helpers must equal plain whole-series windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadence.operators.blocks import (following, framed, nearest_valid, previous, row_index, running_sum,
                                      time_chunk)

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    rows = []
    eid = 0
    for s in range(4):
        n = rnd.randint(1, 60) if s else 150  # one hot series
        t = 0
        for _ in range(n):
            t += rnd.choice([0, 60, 600, 3600, 7200, 40000])
            v = None if rnd.random() < 0.15 else round(rnd.uniform(-5, 5), 2)
            rows.append((s, eid, t, v))
            eid += 1
    df = spark.createDataFrame(rows, "s long, id long, sec long, v double")
    return df.withColumn("ts", F.timestamp_seconds("sec"))


def whole(df):
    return Window.partitionBy("s").orderBy("ts", "id")


def by_id(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_row_index(data):
    got = row_index(data, "s", ["ts", "id"], time_chunk("ts", HOUR), "rn")
    ref = data.withColumn("rn", F.row_number().over(whole(data)))
    assert by_id(got, "rn") == by_id(ref, "rn")


def test_running_sum(data):
    got = running_sum(data, "s", ["ts", "id"], time_chunk("ts", HOUR), "v", "cs")
    ref = data.withColumn("cs", F.sum("v").over(whole(data).rowsBetween(Window.unboundedPreceding, 0)))
    g, r = by_id(got, "cs"), by_id(ref, "cs")
    assert g.keys() == r.keys()
    for k in g:
        assert (g[k][0] is None and r[k][0] is None) or abs(g[k][0] - r[k][0]) < 1e-9


def test_previous_and_following(data):
    got = previous(data, "s", ["ts", "id"], time_chunk("ts", HOUR), ["v", "id"], "_p")
    got = following(got, "s", ["ts", "id"], time_chunk("ts", HOUR), ["v", "id"], "_n")
    w = whole(data)
    ref = data.select("*", F.lag("v").over(w).alias("v_p"), F.lag("id").over(w).alias("id_p"),
                      F.lead("v").over(w).alias("v_n"), F.lead("id").over(w).alias("id_n"))
    cols = ("v_p", "id_p", "v_n", "id_n")
    assert by_id(got, *cols) == by_id(ref, *cols)


def test_nearest_valid(data):
    d = data.withColumn("us", F.unix_micros("ts"))
    got = nearest_valid(d, "s", ["ts", "id"], time_chunk("ts", HOUR), ["v"], "us")
    w = whole(d)
    val = F.when(F.col("v").isNotNull(), F.struct(F.col("us").alias("t"), F.col("v").alias("v")))
    ref = d.select("*", F.last(val, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("v_prv"),
                   F.first(val, True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("v_nxt"))
    assert by_id(got, "v_prv", "v_nxt") == by_id(ref, "v_prv", "v_nxt")


@pytest.mark.parametrize("lo,hi", [(0, 13), (-7, -1), (-55, 0), (-2, 3)])
def test_framed_block_halo(data, lo, hi):
    d = row_index(data, "s", ["ts", "id"], time_chunk("ts", HOUR), "rn")
    block = max(-lo, hi, 1)  # smallest legal block: every frame crosses blocks
    got = framed(d, "s", "rn", lo, hi, {"c": lambda w: F.count("v").over(w),
                                        "m": lambda w: F.sum("v").over(w)}, block=block)
    w = Window.partitionBy("s").orderBy("rn").rowsBetween(lo, hi)
    ref = d.select("*", F.count("v").over(w).alias("c"), F.sum("v").over(w).alias("m"))
    g, r = by_id(got, "c", "m"), by_id(ref, "c", "m")
    assert g.keys() == r.keys()
    for k in g:
        assert g[k][0] == r[k][0]
        assert (g[k][1] is None and r[k][1] is None) or abs(g[k][1] - r[k][1]) < 1e-9


def test_hot_series_is_spread_over_tasks(spark):
    """One series with a third of all rows: the block windows put its rows in
    many shuffle partitions, each bounded by block size + halo."""
    hot = [(0, i, i * 10) for i in range(3000)]
    cold = [(s, 10_000 * s + i, i * 10) for s in range(1, 61) for i in range(100)]
    df = spark.createDataFrame(hot + cold, "s long, id long, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    prev = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = row_index(df, "s", ["ts", "id"], time_chunk("ts", HOUR), "rn")
        out = framed(d, "s", "rn", 0, 13, {"w": lambda w: F.count("id").over(w)}, block=256)
        parts = (out.filter("s = 0 AND w > 0").select(F.spark_partition_id().alias("p"), "w")
                    .groupBy("p").agg(F.count("w").alias("count")).collect())
        assert len(parts) >= 3
        assert max(r["count"] for r in parts) < 3000
        assert out.filter("s = 0").count() == 3000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", prev)


def test_ranges_follow_the_rows(spark):
    """A burst is cut by its rows, sparse series share ranges, nulls are keys."""
    from cadence.operators.blocks import ranged
    burst = spark.range(20_000).select(F.lit(1).cast("long").alias("s"), F.col("id"), F.timestamp_seconds(F.col("id") % 60).alias("ts"))
    later = spark.range(1).select(F.lit(1).cast("long").alias("s"), (F.col("id") + 20_000).alias("id"), F.timestamp_seconds(F.lit(31_536_000)).alias("ts"))
    sparse = spark.range(500).select((F.col("id") + 2).alias("s"), (F.col("id") + 30_000).alias("id"), F.timestamp_seconds(F.col("id") * 86_400).alias("ts"))
    nulls = spark.range(6).select(F.lit(None).cast("long").alias("s"), (F.col("id") + 40_000).alias("id"),
                                  F.when(F.col("id") < 3, F.timestamp_seconds("id")).alias("ts"))
    df = burst.union(later).union(sparse).union(nulls).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = ranged(df, ["s"], ["ts", "id"]).groupBy("_ck").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(n) >= 3 and max(r["count"] for r in n) <= 2 * 20_507 / len(n)
    got = row_index(df, "s", ["ts", "id"], name="rn")
    ref = df.withColumn("rn", F.row_number().over(whole(df)))
    assert by_id(got, "rn") == by_id(ref, "rn")
    prev = previous(df, "s", ["ts", "id"], None, ["id"], "_p")
    want = df.withColumn("id_p", F.lag("id").over(whole(df)))
    assert by_id(prev, "id_p") == by_id(want, "id_p")


def test_nearest_valid_is_not_joined(spark):
    """Counted chunks, null series and stamps, two columns, one without any value in a series: the carried values
    enter the window as rows, so nothing is joined after it."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("s"),
                                  F.when(F.col("id") > 9, F.timestamp_seconds(F.col("id") * 60)).alias("ts"))
    df = df.select("*", F.when(F.col("id") % 400 == 5, F.col("id") * 1.5).alias("v"),
                   F.when((F.col("id") % 50 == 0) & (F.col("s") == 1), F.col("id")).alias("u"), F.unix_micros("ts").alias("us"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = nearest_valid(df, "s", ["ts", "id"], None, ["v", "u"], "us")
        found = by_id(got, "v_prv", "v_nxt", "u_prv", "u_nxt")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = df
    for c in ("v", "u"):
        val = F.when(F.col(c).isNotNull(), F.struct(F.col("us").alias("t"), F.col(c).alias("v")))
        want = want.select("*", F.last(val, True).over(whole(df).rowsBetween(Window.unboundedPreceding, 0)).alias(f"{c}_prv"),
                           F.first(val, True).over(whole(df).rowsBetween(0, Window.unboundedFollowing)).alias(f"{c}_nxt"))
    assert got.columns == want.select("id", "s", "ts", "v", "u", "us", "v_prv", "u_prv", "v_nxt", "u_nxt").columns
    assert found == by_id(want, "v_prv", "v_nxt", "u_prv", "u_nxt")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_huge_methods_are_not_generated_unless_the_session_says_so(spark):
    from cadence.session import pin
    key, was = "spark.sql.codegen.hugeMethodLimit", spark.conf.get("spark.sql.codegen.hugeMethodLimit", None)
    try:
        spark.conf.unset(key)
        assert pin(spark).conf.get(key) == "8000"
        spark.conf.set(key, "30000")
        assert pin(spark).conf.get(key) == "30000"
    finally:
        spark.conf.set(key, was or "8000")


def test_previous_is_not_joined(spark):
    """Counted chunks, null series and stamps, the order's column among the values: the value carried from the chunk
    before enters the window as a row, and the last values of the chunks are not found by a sort of all rows."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("s"),
                                  F.when(F.col("id") > 9, F.timestamp_seconds(F.col("id") * 60)).alias("ts"))
    df = df.withColumn("v", F.when(F.col("id") % 4 > 0, F.col("id") * 1.5))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = previous(df, "s", ["ts", "id"], None, ["v", "id", "ts"], "_p")
        found = by_id(got, "v_p", "id_p", "ts_p")
        alone = previous(df.filter("ts IS NOT NULL"), "s", ["ts"], None, ["v"], "_p", within=[], keep_chunk=True)
        chunks = alone.select("_ck").distinct().count()
        again = by_id(alone, "v_p")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = df.select("*", *[F.lag(c).over(whole(df)).alias(f"{c}_p") for c in ("v", "id", "ts")])
    assert got.columns == want.columns and found == by_id(want, "v_p", "id_p", "ts_p")
    want = df.filter("ts IS NOT NULL").withColumn("v_p", F.lag("v").over(whole(df)))
    assert chunks > 1 and again == by_id(want, "v_p")
    for x in (got, alone):
        assert "Join" not in x._jdf.queryExecution().optimizedPlan().toString()
    assert "SortAggregate" not in alone._jdf.queryExecution().executedPlan().toString()


def test_running_sum_is_not_joined(spark):
    """Counted chunks, null series, stamps and values, a series without any value: the sum of the chunks before enters
    the window as a row, and a chunk's first rows without a value keep it."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("s"),
                                  F.when(F.col("id") > 9, F.timestamp_seconds(F.col("id") * 60)).alias("ts"))
    df = df.withColumn("v", F.when((F.col("id") % 5 > 0) & (F.col("id") > 40) & (F.col("s") != 2), F.col("id") * 0.5))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_sum(df, "s", ["ts", "id"], None, "v", "sum")
        found = by_id(got, "sum")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = df.withColumn("sum", F.sum("v").over(whole(df).rowsBetween(Window.unboundedPreceding, 0)))
    assert got.columns == want.columns and found == by_id(want, "sum")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
