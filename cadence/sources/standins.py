"""Reference-shaped inputs derived by Spark from the given test tables.

The reference's raw logs (task lifecycle stamps, endpoint and function
dimensions, metric samples, per-client model weights) are not shipped, so the
registered queries derive tables of the same shape from the star-schema test
data. Every derivation is a plain projection/join, so its size grows with the
input tables.

* tasks      <- lineitem ⋈ orders   (six ns lifecycle stamps per task)
* endpoints  <- supplier ⋈ nation ⋈ region
* functions  <- part
* samples    <- events ⋈ customer ⋈ nation (counters, gauges with label maps)
* client weights <- embeddings
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.blocks import materialize, running_sum

NS_PER_S = 1_000_000_000


def _ns(expr: str) -> F.Column:
    return F.expr(f"cast(round({expr}) as bigint)")


def tasks_from_orders(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One task per line item; stamps are ns since epoch, stage by stage."""
    o = orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    j = lineitem.join(o, lineitem.l_orderkey == o.o_orderkey, "inner")
    received = (F.unix_micros("o_orderdate") * F.lit(1000)
                + F.col("l_linenumber").cast("long") * F.lit(3600 * NS_PER_S)
                + F.col("l_partkey") * F.lit(NS_PER_S))
    t = j.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("task_uuid"),
        F.col("l_partkey").cast("string").alias("function_uuid"),
        F.col("l_suppkey").cast("string").alias("endpoint_uuid"),
        received.alias("received"),
        _ns("l_quantity * 1e9").alias("_d1"),
        _ns("l_discount * 1e12").alias("_d2"),
        _ns("l_tax * 1e12").alias("_d3"),
        _ns("l_extendedprice * 1e6").alias("_d4"),
        _ns("o_totalprice * 1e3").alias("_d5"),
        _ns("l_extendedprice").alias("argument_size"),
    )
    return t.select(
        "task_uuid", "function_uuid", "endpoint_uuid", "received",
        (F.col("received") + F.col("_d1")).alias("waiting_for_nodes"),
        (F.col("received") + F.col("_d1") + F.col("_d2")).alias("waiting_for_launch"),
        (F.col("received") + F.col("_d1") + F.col("_d2") + F.col("_d3")).alias("execution_start"),
        (F.col("received") + F.col("_d1") + F.col("_d2") + F.col("_d3") + F.col("_d4")).alias("execution_end"),
        (F.col("received") + F.col("_d1") + F.col("_d2") + F.col("_d3") + F.col("_d4") + F.col("_d5"))
        .alias("result_received"),
        "argument_size",
    )


def endpoints_from_suppliers(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    n = nation.select("n_nationkey", "n_regionkey")
    r = region.select("r_regionkey", "r_name")
    j = supplier.join(n, supplier.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(
        F.col("s_suppkey").cast("string").alias("endpoint_uuid"),
        F.regexp_replace("r_name", " ", "_").alias("endpoint_type"),
        F.concat(F.lit("1."), F.col("n_regionkey").cast("string")).alias("endpoint_version"),
    )


def functions_from_parts(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").cast("string").alias("function_uuid"),
        F.col("p_size").alias("loc"),
        F.floor(F.col("p_retailprice") / 100).cast("int").alias("cyc_complexity"),
        F.length("p_brand").alias("num_of_imports"),
    )


# Metric names the dashboards query.
CPU = "container_cpu_usage_seconds_total"
RSS = "container_memory_rss"
RX = "container_network_receive_bytes_total"
TX = "container_network_transmit_bytes_total"
CACHE = "container_memory_cache"
START = "container_start_time_seconds"


METRICS = (CPU, RX, RSS, START)


def _labels() -> F.Column:
    return F.create_map(F.lit("instance"), F.col("n_name"), F.lit("name"), F.col("c_mktsegment"),
                        F.lit("id"), F.col("user_id").cast("string"))


def _containers(users: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    c = customer.select("c_custkey", "c_mktsegment", "c_nationkey")
    n = nation.select("n_nationkey", "n_name")
    return users.join(c, users.user_id == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)


def series_from_events(events: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """The series ``(name, labels)`` of :func:`samples_from_events` without their
    samples: a distinct over the user column and the dimension joins."""
    users = _containers(events.select("user_id").distinct(), customer, nation)
    return users.select(F.explode(F.array(*map(F.lit, METRICS))).alias("name"), _labels().alias("labels"))


def samples_from_events(events: DataFrame, customer: DataFrame, nation: DataFrame, metrics=METRICS) -> DataFrame:
    """Metric samples ``(name, labels, ts, value)`` from the event stream.

    Each user is a container (labels: instance = nation, name = market segment,
    id = user). Per event it reports: a CPU counter that restarts every day
    (running sum of ``value`` within the day), a network counter that never
    restarts, the memory gauge ``value`` and the start time of the day's run; if asked
    for, also a counter and a gauge of the number in its ``props`` (sent, cache). Only
    what the asked ``metrics`` need is computed: the two counters are ordered
    passes, the start is an aggregate, the gauge is neither.
    """
    columns = ["event_id", "user_id", "ts", "value"]
    if TX in metrics or CACHE in metrics:
        events = events.withColumn("k", F.expr("try_cast(regexp_extract(props, '[0-9]+', 0) as double)"))
        columns.append("k")
    e = _containers(events.select(columns), customer, nation).withColumn("day", F.to_date("ts"))
    values = {RSS: "value", CACHE: "k"}
    if CPU in metrics:
        e, values[CPU] = running_sum(e, ["user_id", "day"], ["ts", "event_id"], None, "value", "cpu"), "cpu"
    if RX in metrics:
        e, values[RX] = running_sum(e, ["user_id"], ["ts", "event_id"], None, "value", "rx"), "rx"
    if TX in metrics:
        e, values[TX] = running_sum(e, ["user_id"], ["ts", "event_id"], None, "k", "tx"), "tx"
    if START in metrics:
        e = materialize(e) if len(values) > 2 else e  # read by the day-start aggregate and by the rows it is joined to
        starts = e.groupBy("user_id", "day").agg(F.min("ts").alias("start"))
        e = e.join(starts, ["user_id", "day"]).withColumn("start_s", F.unix_seconds(F.col("start").cast("timestamp")).cast("double"))
        values[START] = "start_s"
    kinds = F.array(*[F.struct(F.lit(m).alias("name"), F.col(values[m]).alias("value")) for m in metrics])
    return (e.select(_labels().alias("labels"), "ts", F.explode(kinds).alias("k"))
             .select(F.col("k.name").alias("name"), "labels", "ts", F.col("k.value").alias("value")))


def _n_positive(emb: str = "embedding") -> F.Column:
    return F.size(F.filter(F.col(emb), lambda x: x > 0)).cast("long")


def client_weights_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """``(round, client, layer, n, weights)``: a vector per client and round,
    cut into two layers; ``n`` = positive entries (the client's sample count)."""
    base = embeddings.select(
        F.col("label").alias("round"), F.col("vec_id").alias("client"), _n_positive().alias("n"),
        F.transform("embedding", lambda x: x.cast("double")).alias("w"))
    half = F.floor(F.size("w") / 2).cast("int")
    layers = F.array(
        F.struct(F.lit(0).alias("layer"), F.slice("w", 1, half).alias("weights")),
        F.struct(F.lit(1).alias("layer"), F.slice("w", half + 1, F.size("w") - half).alias("weights")))
    return (base.select("round", "client", "n", F.explode(layers).alias("l"))
                .select("round", "client", F.col("l.layer").alias("layer"), "n", F.col("l.weights").alias("weights")))
