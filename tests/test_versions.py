"""Versions published at once, tables bucketed alike, CSV lines that don't fit."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cadence.sources import bucketed_join, drop_versions, publish, published, read_csv_checked, schemas, versions, write_bucketed


def one(spark, v):
    return spark.createDataFrame([(v, "a")], "v int, sid string")


def test_readers_see_whole_versions_only(spark, tmp_path):
    root = str(tmp_path / "set")
    assert versions(spark, root) == []
    with pytest.raises(ValueError):
        published(spark, root, ["train"])
    first = publish(spark, {"train": one(spark, 1), "test": one(spark, 2)}, root)
    second = publish(spark, {"train": one(spark, 3), "test": one(spark, 4)}, root, {"test": ["sid"]})
    broken = one(spark, 5).selectExpr("v", "raise_error('lost') as sid")
    with pytest.raises(Exception, match="lost"):
        publish(spark, {"train": one(spark, 5), "test": broken}, root)
    assert versions(spark, root) == [first, second]
    for version, wanted in ((None, [3, 4]), (first, [1, 2])):
        t = published(spark, root, ["train", "test"], version)
        assert [t[n].first()["v"] for n in ("train", "test")] == wanted
    assert (tmp_path / "set" / second / "test" / "sid=a").is_dir()
    assert drop_versions(spark, root, keep=1) == [first]
    assert versions(spark, root) == [second] and not (tmp_path / "set" / first).exists()
    with pytest.raises(ValueError):
        published(spark, root, ["train"], first)


def test_bucketed_join_moves_no_rows(spark, tmp_path):
    hour = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    keys = ["sid", "ts"]
    left = spark.createDataFrame([(1 if i % 3 else i, hour(i), i) for i in range(300)], "sid long, ts timestamp, a long")
    right = spark.createDataFrame([(1 if i % 3 else i, hour(i), -i) for i in range(0, 300, 2)], "sid long, ts timestamp, b long")
    l, r = (write_bucketed(d, str(tmp_path / n), keys, 8) for d, n in ((left, "l"), (right, "r")))
    joined = bucketed_join(l, r, keys, "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    plain = left.join(right, keys, "left")
    assert sorted(map(tuple, joined.fillna(0).collect())) == sorted(map(tuple, plain.fillna(0).collect()))
    sizes = [r["count"] for r in l.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 100  # the long series (201 rows) is in several buckets


def test_csv_lines_that_do_not_fit_are_kept_and_marked(spark, tmp_path):
    (tmp_path / "e.csv").write_text("event_id,ts,user_id,event_type,value\n"
                                    "1,2024-01-01 00:00:07.179575,8,click,6.5\n"
                                    "2,2024-01-01 00:00:08,8,click\n"
                                    "x,2024-01-01 00:00:09,8,view,1.0\n"
                                    "4,,,,\n"
                                    "5,2024-01-01 00:00:10,8,view,1.0,more\n")
    got = read_csv_checked(spark, str(tmp_path), schemas.EVENTS).collect()
    assert [r["_bad_line"] for r in got] == [None, "2,2024-01-01 00:00:08,8,click", "x,2024-01-01 00:00:09,8,view,1.0", None,
                                             "5,2024-01-01 00:00:10,8,view,1.0,more"]
    assert [r["event_id"] for r in got] == [1, 2, None, 4, 5] and got[0]["ts"].microsecond == 179575
    assert got[2]["event_type"] == "view" and got[3]["value"] is None
