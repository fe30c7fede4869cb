"""Sinks (S4-S8, S10).

Outputs are written in parallel, partitioned by the keys readers prune on; a
single-file export (``coalesce(1)``) exists only as an explicit option for small
reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by=None, fmt: str = "parquet",
                mode: str = "overwrite", sort_within=None) -> None:
    """One parallel pass; ``partition_by`` fans out per series / split."""
    out = df
    if sort_within:
        out = out.sortWithinPartitions(*sort_within)
    w = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def export_single_file(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Small report to one file (S4/S7). Not for tables that grow with the data."""
    w = df.coalesce(1).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def append_gauges(df: DataFrame, path: str) -> None:
    """Append ``(name, labels, ts, value)`` rows."""
    df.write.mode("append").parquet(path)
