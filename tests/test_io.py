"""Sources and sinks: typed CSV scan, partitioned publish and pruned reads."""

import os
import re
import tempfile

from pyspark.sql import functions as F

from cadence.plans import publish
from cadence.operators import scale
from cadence.sources import read_csv, schemas, export_single_file


def test_csv_scan_with_explicit_schema(spark):
    d = tempfile.mkdtemp(prefix="cadence-csv-")
    path = os.path.join(d, "endpoints.csv")
    with open(path, "w") as f:
        f.write("endpoint_uuid,endpoint_type,endpoint_version\nabc,LocalProvider,0.3.4\n")
    df = read_csv(spark, path, schemas.ENDPOINTS)
    assert df.first().asDict() == {"endpoint_uuid": "abc", "endpoint_type": "LocalProvider",
                                   "endpoint_version": "0.3.4"}


def test_publish_and_read_splits_prunes(spark):
    d = tempfile.mkdtemp(prefix="cadence-pub-")
    df = spark.createDataFrame([(1, "train", [1.0]), (1, "test", [2.0]), (2, "train", [3.0])],
                               "sid int, split string, x_seq array<double>")
    publish.publish_windows(df, os.path.join(d, "w"))
    assert sorted(f for f in os.listdir(os.path.join(d, "w")) if f.startswith("split=")) == \
        ["split=test", "split=train"]
    test = publish.load_windows(spark, os.path.join(d, "w"), ["test"])
    assert [r["x_seq"] for r in test.collect()] == [[2.0]]
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*split", plan)
    publish.fan_out(df, os.path.join(d, "by_series"), "sid", by_split=True)
    assert sorted(f for f in os.listdir(os.path.join(d, "by_series")) if f.startswith("sid=")) == ["sid=1", "sid=2"]


def test_params_round_trip_and_single_file_export(spark):
    d = tempfile.mkdtemp(prefix="cadence-params-")
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "sid string, x double")
    p = scale.fit_scaler(df, "sid", ["x"], with_mean=True)
    publish.save_params(p, os.path.join(d, "p"))
    back = publish.load_params(spark, os.path.join(d, "p"))
    assert back.collect() == p.collect()
    export_single_file(df.withColumn("y", F.col("x") * 2), os.path.join(d, "csv"))
    parts = [f for f in os.listdir(os.path.join(d, "csv")) if f.endswith(".csv")]
    assert len(parts) == 1
