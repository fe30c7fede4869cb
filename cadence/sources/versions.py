"""Publishing several tables as one version (S4-S8), and tables laid out for joins.

A version is a folder of tables that becomes visible at once: its tables are
written in parallel first, and an empty mark beside them is created last. Readers
take the newest marked version, so they never see half of a train/test pair, nor the
parameters of another run; a writer that dies leaves an unmarked folder that nobody
reads.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from cadence.sources.sinks import write_table

_MARKS = "_published"


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, partition_by: dict[str, list[str]] | None = None) -> str:
    """Writes ``tables`` under ``root`` as one new version and returns its name. Names
    ascend with time; two writers at once get two versions."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        write_table(df, f"{root}/{version}/{name}", partition_by=(partition_by or {}).get(name), mode="error")
    fs, mark = _files(spark, f"{root}/{_MARKS}/{version}")
    fs.create(mark, False).close()
    return version


def versions(spark: SparkSession, root: str) -> list[str]:
    """Published versions, oldest first; none where nothing has been published."""
    fs, marks = _files(spark, f"{root}/{_MARKS}")
    return sorted(s.getPath().getName() for s in fs.listStatus(marks)) if fs.exists(marks) else []


def published(spark: SparkSession, root: str, names: list[str], version: str | None = None) -> dict[str, DataFrame]:
    """The named tables of one version, by default the newest published."""
    known = versions(spark, root)
    if not known or version is not None and version not in known:
        raise ValueError(f"no published version {version or ''} under {root}")
    return {name: spark.read.parquet(f"{root}/{version or known[-1]}/{name}") for name in names}


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes all but the newest ``keep`` published versions, the marks first."""
    old = versions(spark, root)[:-keep or None]
    for version in old:
        for path in (f"{root}/{_MARKS}/{version}", f"{root}/{version}"):
            fs, p = _files(spark, path)
            fs.delete(p, True)
    return old


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int, table: str | None = None) -> DataFrame:
    """``df`` written once in ``buckets`` files hashed and sorted by ``keys``, and read
    back through the catalog. Tables with equal keys and buckets join on all ``keys``
    without a shuffle (:func:`bucketed_join`). With the time among the keys, a series
    that holds a third of the rows is spread over all buckets."""
    name = table or f"bucketed_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
       .mode("overwrite").option("path", path).format("parquet").saveAsTable(name))
    return df.sparkSession.table(name)


def bucketed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Merge join of two tables of :func:`write_bucketed` on all their keys, bucket by
    bucket: neither side is shuffled or broadcast, whatever its size."""
    return left.join(right.hint("merge"), keys, how)
