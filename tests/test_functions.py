import datetime as dt

from pyspark.sql import functions as F

from cadence.functions import (label_match, ns_to_seconds, ns_to_timestamp, one_hot_name, parse_hour_string,
                               parse_iso_offset, parse_wall_clock, week_ending_sunday)


def test_ns_to_second_is_integer_exact(spark):
    df = spark.createDataFrame([(1700000000999999999,)], "received long")
    r = df.select(ns_to_seconds("received").alias("s"), ns_to_timestamp("received").alias("t")).first()
    assert r["s"] == 1700000000  # a double division would land in the next second
    assert r["t"].replace(tzinfo=None) == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_iso_offset_instant_and_wall_clock(spark):
    df = spark.createDataFrame([("2023-01-01T00:00:00.000+01:00",)], "s string")
    r = df.select(parse_iso_offset("s").cast("timestamp_ntz").alias("instant"),
                  parse_wall_clock("s").cast("timestamp_ntz").alias("wall")).first()
    assert r["instant"] == dt.datetime(2022, 12, 31, 23, 0, 0)  # offset honoured
    assert r["wall"] == dt.datetime(2023, 1, 1, 0, 0, 0)        # F6: offset cut off


def test_hour_string(spark):
    df = spark.createDataFrame([("2023-06-10:20",)], "s string")
    assert df.select(parse_hour_string("s").cast("timestamp_ntz")).first()[0] == dt.datetime(2023, 6, 10, 20)


def test_one_hot_name():
    assert one_hot_name("e_vers_", "0.3.4") == "e_vers_0_3_4"


def test_week_ending_sunday(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 7),), (dt.date(2024, 1, 8),)], "d date")
    got = [r[0] for r in df.select(week_ending_sunday(F.col("d").cast("timestamp"))).collect()]
    assert got == [dt.date(2024, 1, 7), dt.date(2024, 1, 14)]


def test_label_matchers_anchor_and_missing_label(spark):
    df = spark.createDataFrame([({"name": "dashboard"},), ({"name": "app1"},), ({},)],
                               "labels map<string,string>")
    keep = df.filter(label_match("name", "=~", ".+") & label_match("name", "!~", "(monitor|collector|dashboard)"))
    assert [r["labels"] for r in keep.collect()] == [{"name": "app1"}]
    # anchored: "app" does not match "app1"
    assert df.filter(label_match("name", "=~", "app")).count() == 0
    # missing label reads as '' and matches ""
    assert df.filter(label_match("name", "=", "")).count() == 1
