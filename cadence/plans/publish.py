"""Publishing outputs (S4-S8): one parallel write per table, partitioned by
the keys later readers prune on; no collect to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadence.sources.sinks import write_table
from cadence.sources.tables import read_splits


def publish_windows(windows: DataFrame, path: str, by=("split",)) -> None:
    """Train/test windows as one dataset partitioned by split."""
    write_table(windows, path, partition_by=list(by))


def load_windows(spark: SparkSession, path: str, splits=("train", "test")) -> DataFrame:
    """Named splits of a published dataset (S3); other splits are pruned."""
    return read_splits(spark, path, splits)


def save_params(params: DataFrame, path: str) -> None:
    """Scaler parameter table."""
    write_table(params, path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def fan_out(df: DataFrame, path: str, series: str, by_split: bool = False) -> None:
    """One folder per series (and split) in a single pass."""
    write_table(df, path, partition_by=[series] + (["split"] if by_split else []))
