"""Star-join cleaning of invocation logs.

``clean_tasks`` is the whole first stage as one lazy plan: the fact table is
joined to its two dimensions (Spark broadcasts them when their size statistics
are under the broadcast threshold, otherwise it shuffles), rows with nulls are
dropped, ns stamps become a second-resolution timestamp and its parts, the six
lifecycle stage durations are column subtractions and endpoint categories become
0/1 columns. No RDD, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions.names import category_columns
from cadence.functions.time import ns_to_timestamp
from cadence.operators.features import distinct_pairs, melt_nonzero, one_hot
from cadence.operators.join import BLOCK_ROWS, salted_join

# Lifecycle stages of a task, name -> (end stamp, start stamp),
# all ns since epoch.
STAGES = {
    "assignment_time": ("waiting_for_nodes", "received"),
    "scheduling_time": ("waiting_for_launch", "waiting_for_nodes"),
    "queue_time": ("execution_start", "waiting_for_launch"),
    "execution_time": ("execution_end", "execution_start"),
    "results_time": ("result_received", "execution_end"),
    "total_execution_time": ("result_received", "received"),
}


def stage_durations(tasks: DataFrame, keep=("task_uuid",)) -> DataFrame:
    """Six stage durations (P4) and ``system_processing_time`` (P5)."""
    d = {k: F.col(a) - F.col(b) for k, (a, b) in STAGES.items()}
    out = tasks.select(*keep, *[v.alias(k) for k, v in d.items()])
    return out.withColumn("system_processing_time",
                          F.col("scheduling_time") + F.col("queue_time") + F.col("execution_time"))


def drop_prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Drop every column whose name starts with ``prefix``."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def clean_tasks(tasks: DataFrame, endpoints: DataFrame, functions: DataFrame,
                type_categories=None, version_categories=None) -> DataFrame:
    """Joined, null-free, per-task rows with stage durations and one-hots.

    Categories default to those of the endpoints that occur in the tasks (one
    aggregate over the dimension and the tasks' key column); pass lists (empty ones
    where no one-hots are wanted) to keep the plan free of that job.
    """
    t = tasks.drop("anonymized_user_uuid")
    f = functions.drop("function_body_uuid")
    j = t.join(endpoints, "endpoint_uuid", "inner").join(f, "function_uuid", "inner").dropna("any")
    if type_categories is None or version_categories is None:
        occurring = endpoints.join(t.select("endpoint_uuid").distinct(), "endpoint_uuid", "left_semi")
        pairs = distinct_pairs(occurring, "endpoint_type", "endpoint_version")  # one job for both lists
        if type_categories is None:
            type_categories = sorted({a for a, _ in pairs if a is not None})
        if version_categories is None:
            version_categories = sorted({b for _, b in pairs if b is not None})
    ts = ns_to_timestamp("received")
    durations = [(F.col(a) - F.col(b)).alias(k) for k, (a, b) in STAGES.items()]
    out = j.select(
        "function_uuid", "endpoint_uuid", "task_uuid",
        ts.alias("timestamp"),
        F.to_date(ts).alias("date"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute"),
        F.second(ts).alias("second"),
        *durations,
        "argument_size", "loc", "cyc_complexity", "num_of_imports",
        *category_columns("endpoint_type", "e_type_", type_categories),
        *category_columns("endpoint_version", "e_vers_", version_categories),
    )
    return out.dropna("any")


def clean_minutes(durations: DataFrame, memory: DataFrame, counts: DataFrame, keys, function: str, trigger: str,
                  minutes, rows: int = BLOCK_ROWS) -> DataFrame:
    """The wide per-minute data set as one long table (J3, R1, R2, P11): ``durations`` and
    ``memory`` joined on ``keys``, then ``counts`` (a column per minute), a row per minute
    that is not zero, and a 0/1 column per trigger.

    Durations and counts both have several rows per key and are joined many to
    many; a key that holds a large share of either is joined in blocks of ``rows``
    rows. ``function`` is that of ``durations``."""
    keys, minutes = list(keys), list(minutes)
    d = salted_join(durations, memory, keys, rows)
    c = one_hot(counts.drop(function), trigger, "Trigger_")
    wide = salted_join(d, c, keys, rows)
    return melt_nonzero(wide, [x for x in wide.columns if x not in minutes], minutes, "minute", "invocations")
