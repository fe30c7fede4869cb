"""Structured Streaming forms of the feature, rate and gauge queries.

* ``stream_features``: tumbling-window workload features per series with a
  watermark (append mode emits a window once the watermark passes its end;
  later rows for it are dropped as late).
* ``stream_panes``: a counter's samples folded per series and step. Window functions
  such as ``lag`` are refused on streams, so each pane collects its samples, sorts
  them by time and folds the reset-corrected increase. Sliding rates are then
  merged from the panes, one row per series and step, by the batch operator.
* ``run_to_latest``: the state of an aggregate at the end of its input, open windows
  included; ``run_to_table`` appends closed windows only.
* ``stream_gauges``: a streaming aggregate of per-round weighted sums;
  ``foreachBatch`` publishes the updated rounds as gauge rows.

Every query writes to a sink and a checkpoint location below one folder. Give that
folder (``at``) and a query started again resumes where it stopped; without it each
call takes a fresh folder below the shared checkpoint folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cadence.operators.metrics import series_key, to_samples
from cadence.session import checkpoint_dir


def source(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None,
           fmt: str = "parquet") -> DataFrame:
    """File-replay stream source (S9); zone-less stamps become instants."""
    r = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(p) and store.getFileStatus(p).isFile():  # a single file: watch its folder, filtered to its name
        r = r.option("pathGlobFilter", os.path.basename(path))
        path = os.path.dirname(path)
    df = r.load(path)
    for f in schema.fields:
        if f.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def stream_features(stream: DataFrame, series: str, ts: str, window: str, watermark: str,
                    value: str = "value") -> DataFrame:
    """Tumbling-window count / mean / max / sum per series."""
    return (stream.withWatermark(ts, watermark)
                  .groupBy(F.window(ts, window).alias("w"), series)
                  .agg(F.count(F.lit(1)).alias("invocations"), F.avg(value).alias("avg_value"),
                       F.max(value).alias("max_value"), F.sum(value).alias("sum_value"))
                  .select(series, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          "invocations", "avg_value", "max_value", "sum_value"))


def stream_panes(samples: DataFrame, step_s: int, watermark: str) -> DataFrame:
    """Samples of a counter folded per series and step (Z2): the input of ``rate_from_panes``.

    A pane holds the samples of ``(end - step, end]``, as the instants of a range
    query do. State holds the samples of open panes only: each sample once, whatever the range.
    The label set is held once, in the key."""
    s = samples.withColumn("_sid", series_key("labels")).withColumn("_at", F.col("ts") - F.expr("interval 1 microsecond"))
    g = s.withWatermark("_at", watermark).groupBy("name", "_sid", F.window("_at", f"{step_s} seconds").alias("w")).agg(
        F.array_sort(F.collect_list(F.struct(F.unix_micros("ts").alias("t"), F.col("value").alias("v")))).alias("_pts"))
    pts, n = F.col("_pts"), F.size("_pts")
    pairs = F.zip_with(F.slice(pts, 2, F.greatest(n - 1, F.lit(1))), F.slice(pts, 1, F.greatest(n - 1, F.lit(1))),
                       lambda cur, prev: F.when(cur["v"] < prev["v"], cur["v"]).otherwise(cur["v"] - prev["v"]))
    inc = F.aggregate(F.filter(pairs, lambda x: x.isNotNull()), F.lit(0.0), lambda acc, x: acc + x)
    first, last = F.element_at(pts, 1), F.element_at(pts, -1)
    return g.select("name", F.col("_sid").alias("sid"), F.map_from_entries("_sid").alias("labels"), F.expr(f"unix_micros(w.end) div {step_s * 1_000_000}").alias("pane"),
                    n.cast("long").alias("n"), first["t"].alias("t0"), last["t"].alias("t1"), first["v"].alias("v0"),
                    last["v"].alias("v1"), inc.alias("inc"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HEAP_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def _state_store(spark: SparkSession) -> None:
    """Window state grows with series x open windows; keep it in RocksDB
    (off-heap, spills to local disk, snapshots to the checkpoint) unless the
    session chose a provider other than the in-heap default."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, _HEAP_STORE) == _HEAP_STORE:
        spark.conf.set(key, ROCKSDB)


def run_to_table(df: DataFrame, name: str, mode: str = "append", available_now: bool = True,
                 at: str | None = None) -> str:
    """Run a streaming query to the end of its input into a parquet table below
    the folder ``at`` (a fresh one without it); returns the table path. Called again
    with the same folder, it goes on where it stopped."""
    spark = df.sparkSession
    _state_store(spark)
    base = at or checkpoint_dir(spark, f"stream-{name}")
    out, ck = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    w = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode(mode)
    q = (w.trigger(availableNow=True) if available_now else w).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return out


def run_to_latest(df: DataFrame, keys, name: str, at: str | None = None) -> DataFrame:
    """Run a streaming aggregate to the end of its input and return its state there: a
    row per key, windows still open included, so the answer is that of a batch over all
    rows that were not late.

    Every batch writes the rows it updated to a partition of its own (written again
    when it is replayed), and the latest row of a key counts. With the same folder
    ``at`` a query goes on where it stopped; a window that was reported open is then
    reported again with what came later."""
    spark = df.sparkSession
    _state_store(spark)
    base = at or checkpoint_dir(spark, f"stream-{name}")
    out, ck = os.path.join(base, "out"), os.path.join(base, "checkpoint")

    def publish(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy("batch").parquet(out))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)  # an input without rows leaves it empty
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    q = (df.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", ck)
           .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(out)
    latest = F.max_by(F.struct(*df.columns), "batch").alias("_r")
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(latest).select("_r.*")


def stream_gauges(evals: DataFrame, name: str = "gauges", at: str | None = None) -> str:
    """Weighted global metrics per round from a stream of client evaluations,
    published as gauge rows ``model_loss / model_cosine_similarity /
    model_mean_absolute_error`` (Z3, S10). Returns the gauge table path.

    A streaming aggregate keeps the per-round weighted sums (state bounded by
    the number of rounds), so a round whose evaluations arrive over several
    micro-batches is still averaged over all of them; each batch overwrites
    only the rounds it updated (dynamic partition overwrite: replays are
    idempotent).
    """
    spark = evals.sparkSession
    _state_store(spark)
    base = at or checkpoint_dir(spark, f"stream-{name}")
    out, ck = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    n = F.col("n")
    sums = evals.groupBy("round").agg(
        F.count(F.lit(1)).alias("clients"), F.sum(n).alias("n"), F.sum(F.col("loss") * n).alias("_l"),
        F.sum(F.col("cos") * n).alias("_c"), F.sum(F.col("mae") * n).alias("_m"))

    def publish(batch: DataFrame, batch_id: int) -> None:
        tot = F.col("n")
        m = batch.select("round", F.try_divide(F.col("_l"), tot).alias("loss"),
                         F.when(tot != 0, F.col("_c") / tot).otherwise(F.lit(0.0)).alias("cos"),
                         F.when(tot != 0, F.col("_m") / tot).otherwise(F.lit(0.0)).alias("mae"),
                         F.timestamp_seconds(F.col("round").cast("long")).alias("ts"))
        # fixed values: gauge names of the global model
        g = to_samples(m, "ts", {"model_loss": "loss", "model_cosine_similarity": "cos",
                                 "model_mean_absolute_error": "mae"})
        g = g.withColumn("round", F.unix_seconds("ts"))
        (g.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
          .partitionBy("round").parquet(out))

    q = (sums.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", ck)
             .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return out
