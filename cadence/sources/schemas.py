"""Explicit schemas of the raw inputs (no schema inference on big CSVs)."""

from pyspark.sql.types import (BooleanType, 
    StructType, StructField, StringType, LongType, DoubleType, TimestampType, MapType, IntegerType,
    ArrayType,
)

TASKS = StructType([
    StructField("task_uuid", StringType()),
    StructField("anonymized_user_uuid", StringType()),
    StructField("function_uuid", StringType()),
    StructField("endpoint_uuid", StringType()),
    StructField("received", LongType()),
    StructField("waiting_for_nodes", LongType()),
    StructField("waiting_for_launch", LongType()),
    StructField("execution_start", LongType()),
    StructField("execution_end", LongType()),
    StructField("result_received", LongType()),
    StructField("argument_size", LongType()),
])

ENDPOINTS = StructType([
    StructField("endpoint_uuid", StringType()),
    StructField("endpoint_type", StringType()),
    StructField("endpoint_version", StringType()),
])

FUNCTIONS = StructType([
    StructField("function_uuid", StringType()),
    StructField("function_body_uuid", StringType()),
    StructField("loc", DoubleType()),
    StructField("cyc_complexity", DoubleType()),
    StructField("num_of_imports", DoubleType()),
])

EVENTS = StructType([
    StructField("event_id", LongType()),
    StructField("ts", TimestampType()),
    StructField("user_id", LongType()),
    StructField("event_type", StringType()),
    StructField("value", DoubleType()),
])

SAMPLES = StructType([
    StructField("name", StringType()),
    StructField("labels", MapType(StringType(), StringType())),
    StructField("ts", TimestampType()),
    StructField("value", DoubleType()),
])

SCALER_PARAMS = StructType([
    StructField("series_id", StringType()),
    StructField("feature", StringType()),
    StructField("mean", DoubleType()),
    StructField("std", DoubleType()),
    StructField("with_mean", BooleanType()),
])

CLIENT_EVAL = StructType([
    StructField("round", IntegerType()),
    StructField("client", LongType()),
    StructField("n", LongType()),
    StructField("loss", DoubleType()),
    StructField("cos", DoubleType()),
    StructField("mae", DoubleType()),
])

CLIENT_WEIGHTS = StructType([
    StructField("round", IntegerType()),
    StructField("client", LongType()),
    StructField("layer", IntegerType()),
    StructField("n", LongType()),
    StructField("weights", ArrayType(DoubleType())),
])
