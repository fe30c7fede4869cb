"""Typed readers.

Parquet is the default format. Zone-less timestamps (``TIMESTAMP_NTZ``) are cast
to ``TIMESTAMP`` under the session zone (UTC) at the read, because watermarks
refuse NTZ and the operators treat time as instants.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType, TimestampNTZType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def as_instants(df: DataFrame) -> DataFrame:
    """TIMESTAMP_NTZ columns -> TIMESTAMP (same wall clock, read as UTC)."""
    cols = [F.col(f"`{f.name}`").cast("timestamp").alias(f.name) if isinstance(f.dataType, TimestampNTZType)
            else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(*cols)


def load(spark: SparkSession, root: str, name: str, instants: bool = True) -> DataFrame:
    """Read ``<root>/<name>.parquet`` (file or directory)."""
    path = os.path.join(root, f"{name}.parquet")
    df = spark.read.parquet(path)
    return as_instants(df) if instants else df


def read_csv(spark: SparkSession, path: str, schema: StructType, header: bool = True) -> DataFrame:
    """CSV scan with an explicit schema (S1/S2): no inference pass over the data."""
    return spark.read.schema(schema).option("header", header).csv(path)


def read_csv_checked(spark: SparkSession, path: str, schema: StructType, header: bool = True,
                     bad: str = "_bad_line") -> DataFrame:
    """As :func:`read_csv`, with one more column: the whole line where it has too few or
    too many fields or one that isn't of its type (the fields that can be read are kept),
    else null. Nothing is dropped, and the schema's columns are always all parsed."""
    full = StructType([*schema.fields]).add(bad, StringType())
    return (spark.read.schema(full).option("header", header).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", bad).option("enforceSchema", False)
            .option("timestampFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path))


def read_splits(spark: SparkSession, root: str, splits=("train", "test"), split_col: str = "split") -> DataFrame:
    """Read a dataset published as ``root/split=<name>/`` (S3) with partition pruning."""
    df = spark.read.option("basePath", root).parquet(root)
    return df.filter(F.col(split_col).isin(list(splits)))
