"""Hot-series experiment: one series holds a third of the rows.

Derives a larger, skewed table from ``events`` (copies shifted in time; every
third event is re-labelled to user 0), then computes 14-row windows per series
(a) with a plain ``Window.partitionBy(user)`` and (b) with cadence's chunked
block windows, and prints wall time and the slowest task of each.

Usage: python scripts/skew_experiment.py [sf_dir] [copies]
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from cadence.operators.sequence import same_sequences
    from cadence.session import get_session
    from cadence.sources import load

    spark = get_session("local[8]", 16, app="skew-experiment", extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="cadence-skew-"))
    ev = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    big = (ev.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))  # bounded copies
             .select((F.col("event_id") * copies + F.col("k")).alias("event_id"),
                     F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")).alias("user_id"),
                     (F.col("ts") + F.expr("make_dt_interval(30 * k)")).alias("ts"), "value"))
    path = os.path.join(tempfile.mkdtemp(prefix="cadence-skew-data-"), "events")
    big.write.parquet(path)
    big = spark.read.parquet(path)
    n, hot = big.count(), big.filter("user_id = 0").count()
    print(f"rows={n} hot_series_rows={hot} ({hot / n:.0%})")

    def timed(label, df):
        t = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        print(f"{label:10s} {time.perf_counter() - t:7.2f} s")

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, 13)
    naive = (big.withColumn("_w", F.collect_list("value").over(w)).filter(F.size("_w") == 14)
                .select("user_id", "ts", "_w"))
    timed("naive", naive)
    timed("chunked", same_sequences(big, "user_id", "ts", ["value"], [], 14, tiebreak="event_id"))
    timed("naive", naive)
    timed("chunked", same_sequences(big, "user_id", "ts", ["value"], [], 14, tiebreak="event_id"))


if __name__ == "__main__":
    main()
