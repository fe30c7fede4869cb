"""Physical-plan checks: no row-at-a-time Python, no window over
a single partition, broadcast only for bounded sides, pruning reaches the scan."""

import re

import pytest

from conftest import SF

from __spark_entry__ import queries
from cadence.operators import split
from cadence.sources import load

STREAMING = {"stream_features", "stream_rate", "stream_gauges"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _single_partition_windows(plan: str) -> list[str]:
    lines = plan.split("\n")
    bad = []
    for i, line in enumerate(lines):
        if "Window [" not in line:
            continue
        for nxt in lines[i + 1:i + 6]:
            if "Exchange" in nxt:
                if "SinglePartition" in nxt:
                    bad.append(line.strip()[:120])
                break
    return bad


@pytest.mark.parametrize("name", [n for n in queries() if n not in STREAMING])
def test_no_python_rows_and_no_global_windows(spark, name):
    df = queries()[name](spark, SF)
    plan = _plan(df)
    assert "BatchEvalPython" not in plan, "row-at-a-time Python UDF in the plan"
    assert not _single_partition_windows(plan), _single_partition_windows(plan)
    if "MapInPandas" in plan or "ArrowEvalPython" in plan or "FlatMapGroupsInPandas" in plan:
        assert name in {"ar1_diff", "ar1_both_targets", "sarimax_cls", "arx_fit", "arx_forecast", "prediction_table"}, name


def test_top_k_is_bounded_broadcast_semi_join(spark):
    plan = _plan(queries()["top_series"](spark, SF))
    assert "TakeOrderedAndProject" in plan
    assert re.search(r"BroadcastHashJoin .*LeftSemi", plan)


def test_column_pruning_reaches_scan(spark):
    plan = _plan(queries()["stage_durations"](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    line_schema = [s for s in schemas if "l_orderkey" in s][0]
    assert "l_shipdate" not in line_schema and "l_returnflag" not in line_schema


def test_time_filter_pushed_to_scan(spark):
    ev = load(spark, SF, "events")
    plan = _plan(split.time_slice(ev, "ts", "2024-01-05 00:00:00", "2024-01-06 00:00:00"))
    assert re.search(r"PushedFilters: \[[^\]]*ts", plan)
