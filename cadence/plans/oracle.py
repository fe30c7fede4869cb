"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Views ``region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations`` are registered by the caller.
Floating outputs are rounded to 9 significant digits, as the Spark side does.
"""

from __future__ import annotations


def _rounded(n: int) -> str:
    """``v`` half up to ``n`` significant digits, scaled by two exact powers of ten (``e``: the exponent)."""
    e = f"({n - 1}.0 - floor(log10(greatest(abs(v), 1e-30))))"
    s1, s2 = f"pow(10.0, least(abs({e}), 22.0))", f"pow(10.0, greatest(least(abs({e}) - 22.0, 22.0), 0.0))"
    return (f"CASE WHEN abs(v) < 1e-30 THEN 0.0 WHEN NOT abs(v) < 1e50 THEN v "
            f"WHEN {e} >= 0 THEN floor(v * {s1} * {s2} + 0.5) / {s2} / {s1} ELSE floor(v / {s1} / {s2} + 0.5) * {s2} * {s1} END")


def R(x: str) -> str:
    """Same arithmetic as ``cadence.plans.report.report``: snapped to 12 significant
    digits, then half up to 9 (identical in both engines for identical inputs)."""
    return f"list_transform(list_transform([CAST({x} AS DOUBLE)], lambda v: {_rounded(12)}), lambda v: {_rounded(9)})[1]"


def SD(x: str) -> str:
    """Sample std, exactly 0 when all values are equal (as ``fit_scaler``)."""
    return f"CASE WHEN max({x}) = min({x}) THEN 0.0 ELSE coalesce(stddev_samp({x}), 0.0) END"


def RL(x: str) -> str:
    return f"list_transform({x}, lambda w: {R('w')})"


# --------------------------------------------------------------------------- stand-ins

TASKS = """
tasks0 AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS task_uuid,
         CAST(l_partkey AS VARCHAR) AS function_uuid,
         CAST(l_suppkey AS VARCHAR) AS endpoint_uuid,
         epoch_us(o_orderdate) * 1000 + CAST(l_linenumber AS BIGINT) * 3600000000000
           + l_partkey * 1000000000 AS received,
         CAST(round(l_quantity * 1e9) AS BIGINT) AS d1,
         CAST(round(l_discount * 1e12) AS BIGINT) AS d2,
         CAST(round(l_tax * 1e12) AS BIGINT) AS d3,
         CAST(round(l_extendedprice * 1e6) AS BIGINT) AS d4,
         CAST(round(o_totalprice * 1e3) AS BIGINT) AS d5,
         CAST(round(l_extendedprice) AS BIGINT) AS argument_size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tasks AS (
  SELECT task_uuid, function_uuid, endpoint_uuid, received,
         received + d1 AS waiting_for_nodes,
         received + d1 + d2 AS waiting_for_launch,
         received + d1 + d2 + d3 AS execution_start,
         received + d1 + d2 + d3 + d4 AS execution_end,
         received + d1 + d2 + d3 + d4 + d5 AS result_received,
         argument_size
  FROM tasks0)"""

ENDPOINTS = """
endpoints AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS endpoint_uuid,
         replace(r_name, ' ', '_') AS endpoint_type,
         '1.' || CAST(n_regionkey AS VARCHAR) AS endpoint_version
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
functions AS (
  SELECT CAST(p_partkey AS VARCHAR) AS function_uuid, p_size AS loc,
         CAST(floor(p_retailprice / 100) AS INTEGER) AS cyc_complexity,
         length(p_brand) AS num_of_imports
  FROM part)"""

# Category values of the stand-in endpoint dimension (region names / keys).
TYPES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE_EAST"]
VERSIONS = ["1.0", "1.1", "1.2", "1.3", "1.4"]

STAGES = """
  waiting_for_nodes - received AS assignment_time,
  waiting_for_launch - waiting_for_nodes AS scheduling_time,
  execution_start - waiting_for_launch AS queue_time,
  execution_end - execution_start AS execution_time,
  result_received - execution_end AS results_time,
  result_received - received AS total_execution_time"""


def _onehots(col, prefix, values):
    return ",\n  ".join(f"CAST({col} = '{v}' AS INTEGER) AS {prefix}{v.replace('.', '_')}" for v in values)


CLEAN = f"""
clean AS (
  SELECT function_uuid, endpoint_uuid, task_uuid, ts AS "timestamp", CAST(ts AS DATE) AS "date",
    hour(ts) AS "hour", minute(ts) AS "minute", second(ts) AS "second",
    {STAGES},
    argument_size, loc, cyc_complexity, num_of_imports,
    {_onehots('endpoint_type', 'e_type_', TYPES)},
    {_onehots('endpoint_version', 'e_vers_', VERSIONS)}
  FROM (SELECT t.*, e.endpoint_type, e.endpoint_version, f.loc, f.cyc_complexity, f.num_of_imports,
               make_timestamp((received // 1000000000) * 1000000) AS ts
        FROM tasks t JOIN endpoints e USING (endpoint_uuid) JOIN functions f USING (function_uuid)))"""

STAR_CLEAN = f"WITH {TASKS},{ENDPOINTS},{CLEAN}\nSELECT * FROM clean"

STAGE_DURATIONS = f"""WITH {TASKS}
SELECT task_uuid, {STAGES},
  (waiting_for_launch - waiting_for_nodes) + (execution_start - waiting_for_launch)
    + (execution_end - execution_start) AS system_processing_time
FROM tasks"""

TASK_FEATURES = f"""WITH {TASKS},{ENDPOINTS},{CLEAN}
SELECT endpoint_uuid, date_trunc('hour', "timestamp") AS "timestamp", count(*) AS invocations,
  {R('avg(loc)')} AS avg_loc, {R('avg(cyc_complexity)')} AS avg_cyc_complexity,
  {R('avg(num_of_imports)')} AS avg_num_of_imports, {R('avg(argument_size)')} AS avg_argument_size,
  {R('avg(total_execution_time) / 1e9')} AS avg_total_execution_s,
  {R('avg(scheduling_time + queue_time + execution_time) / 1e9')} AS avg_system_processing_s,
  {", ".join(f"max(e_type_{t}) AS e_type_{t}" for t in TYPES)}
FROM clean GROUP BY 1, 2"""

# --------------------------------------------------------------------------- events

FEATS = """
SELECT user_id, date_trunc('{unit}', ts) AS ts, count(*) AS invocations, avg(value) AS avg_value,
       max(value) AS max_value, sum(value) AS sum_value
FROM events GROUP BY 1, 2"""


def feats(unit: str) -> str:
    return FEATS.format(unit=unit)


WORKLOAD_FEATURES = f"""
SELECT user_id, ts, invocations, {R('avg_value')} AS avg_value, {R('max_value')} AS max_value,
       {R('sum_value')} AS sum_value
FROM ({feats('hour')})"""

TOP_SERIES = f"""
WITH top AS (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 10)
SELECT event_id, ts, user_id, event_type, {R('value')} AS value, props
FROM events WHERE user_id IN (SELECT user_id FROM top)"""

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

ONE_HOT_TYPE = f"""
SELECT event_id, ts, user_id, event_type, {R('value')} AS value, props,
  {_onehots('event_type', 'e_type_', EVENT_TYPES)}
FROM events"""

DISTINCT_VALUES = "SELECT DISTINCT event_type FROM events"

MELT_NONZERO = f"""
WITH dur AS (SELECT user_id, event_type, avg(value) AS AverageDuration, count(*) AS CountForDuration
             FROM events GROUP BY 1, 2),
     mem AS (SELECT user_id, avg(value) AS AverageAllocatedMb, count(*) AS CountForMemory
             FROM events GROUP BY 1),
     cells AS (SELECT user_id, event_type, printf('h%02d', hour(ts)) AS minute, count(*) AS invocations
               FROM events GROUP BY 1, 2, 3)
SELECT c.user_id, c.event_type, {R('AverageDuration')} AS AverageDuration, CountForDuration,
       {R('AverageAllocatedMb')} AS AverageAllocatedMb, CountForMemory, minute, invocations
FROM cells c JOIN dur USING (user_id, event_type) JOIN mem USING (user_id)"""

MELT_CHAIN = f"""
WITH e AS (SELECT CAST(user_id % 7 AS VARCHAR) AS HashOwner, CAST(user_id AS VARCHAR) AS HashApp, event_type, hour(ts) AS h, value FROM events),
dur AS (SELECT HashOwner, HashApp, event_type AS HashFunction, avg(value) AS AverageDuration, count(*) AS CountForDuration FROM e GROUP BY 1, 2, 3),
mem AS (SELECT HashOwner, HashApp, avg(value) AS AverageAllocatedMb, count(*) AS CountForMemory FROM e GROUP BY 1, 2),
cells AS (SELECT HashOwner, HashApp, event_type AS "Trigger", printf('h%02d', h) AS minute, count(*) AS invocations FROM e GROUP BY 1, 2, 3, 4)
SELECT HashOwner, HashApp, HashFunction, {R('AverageDuration')} AS AverageDuration, CountForDuration, {R('AverageAllocatedMb')} AS AverageAllocatedMb,
       CountForMemory, "Trigger", {_onehots('"Trigger"', 'Trigger_', EVENT_TYPES)}, minute, invocations
FROM dur JOIN mem USING (HashOwner, HashApp) JOIN cells USING (HashOwner, HashApp)"""

SEEDED_SHUFFLE = f"""
SELECT event_id, ts, user_id, event_type, {R('value')} AS value, props,
       md5(concat_ws(':', CAST(event_id AS VARCHAR), '42')) AS shuffle_key
FROM events ORDER BY shuffle_key"""

SAMPLE_FRACTION = f"""
SELECT event_id, ts, user_id, event_type, {R('value')} AS value, props
FROM events
WHERE ('0x' || substr(md5(concat_ws(':', CAST(event_id AS VARCHAR), '42')), 1, 8))::BIGINT < {int(0.3 * (1 << 32))}"""

TIME_HOLDOUT = f"""
SELECT event_id, user_id, ts, {R('value')} AS value, CAST(ts AS DATE) AS date,
       CASE WHEN CAST(ts AS DATE) < max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) - 7
            THEN 'train' ELSE 'test' END AS split
FROM events"""

TIME_HOLDOUT_GLOBAL = f"""
SELECT event_id, user_id, ts, {R('value')} AS value, CAST(ts AS DATE) AS date,
       CASE WHEN CAST(ts AS DATE) < (SELECT max(CAST(ts AS DATE)) FROM events) - 7
            THEN 'train' ELSE 'test' END AS split
FROM events"""

_POS = """
SELECT event_id, user_id, ts, value,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
       count(*) OVER (PARTITION BY user_id) AS n
FROM events"""

TAIL_HOLDOUT = f"""
SELECT event_id, user_id, ts, {R('value')} AS value,
       CASE WHEN rn <= (n * 4) // 5 THEN 'train' ELSE 'val' END AS split
FROM ({_POS})"""

SHARDS = f"""
SELECT event_id, user_id, ts, {R('value')} AS value,
       CAST(ntile(3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS shard
FROM events"""

SHARDS_GLOBAL = f"""
SELECT event_id, user_id, ts, {R('value')} AS value, CAST(ntile(7) OVER (ORDER BY ts, event_id) AS INTEGER) AS shard
FROM events"""

LAST_N = f"""
SELECT event_id, user_id, ts, {R('value')} AS value
FROM ({_POS}) WHERE n - rn + 1 > 2 AND n - rn + 1 <= 7"""

CONCAT_SPLITS = TIME_HOLDOUT

SCALE_COLS = ["invocations", "avg_value", "max_value", "sum_value"]


def _params(src: str) -> str:
    parts = [f"SELECT user_id, '{c}' AS feature, avg({c}) AS mean, {SD(c)} AS std "
             f"FROM ({src}) GROUP BY user_id" for c in SCALE_COLS]
    return "\nUNION ALL\n".join(parts)


SCALE_FIT = f"""
SELECT user_id, feature, {R('mean')} AS mean, {R('std')} AS std, false AS with_mean
FROM ({_params(feats('hour'))})"""


def _wide(src: str) -> str:
    cols = ", ".join(f"avg({c}) AS m_{c}, {SD(c)} AS s_{c}" for c in SCALE_COLS)
    return f"SELECT user_id, {cols} FROM ({src}) GROUP BY user_id"


SCALE_APPLY = f"""
WITH f AS ({feats('hour')}), p AS ({_wide(feats('hour'))})
SELECT user_id, ts, {", ".join(f"{R(f'CASE WHEN s_{c} = 0 THEN 0.0 ELSE {c} / s_{c} END')} AS {c}" for c in SCALE_COLS)}
FROM f JOIN p USING (user_id)"""

PUBLISH_CHAIN = f"""
WITH f AS ({feats('hour')}),
h AS (SELECT *, CASE WHEN CAST(ts AS DATE) < max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) - 7
                     THEN 'train' ELSE 'test' END AS split FROM f),
p AS ({_wide("SELECT * FROM h WHERE split = 'train'")})
SELECT user_id, ts, split, {", ".join(f"{R(f'CASE WHEN s_{c} = 0 THEN 0.0 ELSE {c} / s_{c} END')} AS {c}" for c in SCALE_COLS)}
FROM h LEFT JOIN p USING (user_id)"""

BUCKETED_FEATURES = f"""
WITH f AS ({feats('hour')}),
e AS (SELECT user_id, date_trunc('hour', ts) AS ts, count(*) AS errors, max(value) AS worst
      FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT user_id, ts, invocations, {R('avg_value')} AS avg_value, coalesce(errors, 0) AS errors, {R('worst')} AS worst
FROM f LEFT JOIN e USING (user_id, ts)"""

CSV_READ_BACK = f"""
SELECT event_id, ts, user_id, event_type, {R('value')} AS value, false AS bad FROM events"""

SCALE_INVERSE = f"""
SELECT user_id, ts, {", ".join(f"{R(f'CAST({c} AS DOUBLE)')} AS {c}" for c in SCALE_COLS)} FROM ({feats('hour')})"""

# Inverse of centred scaling gives back the input exactly except where std = 0,
# where only the mean survives; with whole-number rounding noise removed by R().


def _windows(frame_rows: int, extra_where: str = "") -> str:
    return f"""
WITH f AS ({feats('day')})
SELECT user_id,
  list(ts) OVER w AS tl, list(invocations) OVER w AS il, list(avg_value) OVER w AS al,
  list(max_value) OVER w AS xl, list(sum_value) OVER w AS sl,
  list([CAST(invocations AS DOUBLE), avg_value]) OVER w AS ml
FROM f
WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND {frame_rows - 1} FOLLOWING)"""


SEQUENCES_FUTURE = f"""
SELECT user_id, list_transform(tl[1:7], lambda v: epoch_us(v)) AS ts_seq, il[1:7] AS invocations_seq, {RL('al[1:7]')} AS avg_value_seq,
       list_transform(tl[8:14], lambda v: epoch_us(v)) AS ts_target, {RL('xl[8:14]')} AS max_value_target, {RL('sl[8:14]')} AS sum_value_target
FROM ({_windows(14)}) WHERE len(tl) = 14"""

SEQUENCES_SAME = f"""
SELECT user_id, list_transform(tl, lambda v: epoch_us(v)) AS ts_seq, il AS invocations_seq, {RL('al')} AS avg_value_seq,
       {RL('xl')} AS max_value_target, {RL('sl')} AS sum_value_target
FROM ({_windows(7)}) WHERE len(tl) = 7"""

FIRST_OF_SEQUENCE = f"""
SELECT user_id, tl[1] AS ts_seq_first, {R('xl[1]')} AS max_value_target_first,
       {R('sl[1]')} AS sum_value_target_first
FROM ({_windows(7)}) WHERE len(tl) = 7"""

STACK_STEPS = f"""
SELECT user_id, list_transform(tl, lambda v: epoch_us(v)) AS ts_seq, list_transform(ml, lambda r: {RL('r')}) AS x
FROM ({_windows(7)}) WHERE len(tl) = 7"""

XY_MATRICES = f"""
SELECT user_id, list_transform(tl, lambda v: epoch_us(v)) AS ts_seq, list_transform(ml, lambda r: {RL('r')}) AS x,
       list_transform(generate_series(1, 7), lambda i: {RL('[xl[i], sl[i]]')}) AS y
FROM ({_windows(7)}) WHERE len(tl) = 7"""

TRAINING_WINDOWS = f"""
WITH f AS ({feats('hour')}),
top AS (SELECT user_id FROM f GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 10),
sp AS (SELECT f.*, CASE WHEN CAST(ts AS DATE) < max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) - 7
                        THEN 'train' ELSE 'test' END AS split
       FROM f WHERE user_id IN (SELECT user_id FROM top)),
p AS ({_wide("SELECT * FROM sp WHERE split = 'train'")}),
sc AS (SELECT user_id, split, ts,
         {", ".join(f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE {c} / s_{c} END AS {c}" for c in SCALE_COLS)}
       FROM sp LEFT JOIN p USING (user_id)),
w AS (SELECT user_id, split, list(ts) OVER win AS tl, list(invocations) OVER win AS il,
             list(avg_value) OVER win AS al, list(max_value) OVER win AS xl, list(sum_value) OVER win AS sl
      FROM sc WINDOW win AS (PARTITION BY user_id, split ORDER BY ts ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING))
SELECT user_id, split, list_transform(tl[1:7], lambda v: epoch_us(v)) AS ts_seq, {RL('il[1:7]')} AS invocations_seq, {RL('al[1:7]')} AS avg_value_seq,
       list_transform(tl[8:14], lambda v: epoch_us(v)) AS ts_target, {RL('xl[8:14]')} AS max_value_target, {RL('sl[8:14]')} AS sum_value_target
FROM w WHERE len(tl) = 14"""


# --------------------------------------------------------------------------- series

def _grid_cte(unit: str = "hour") -> str:
    return f"""f AS ({feats(unit)}),
b AS (SELECT user_id, min(ts) AS a, max(ts) AS z FROM f GROUP BY 1),
g AS (SELECT user_id, unnest(generate_series(a, z, INTERVAL 1 {unit})) AS ts FROM b)"""


REGULAR_GRID = f"""WITH {_grid_cte()}
SELECT g.user_id, g.ts, f.invocations, {R('f.avg_value')} AS avg_value, {R('f.max_value')} AS max_value,
       {R('f.sum_value')} AS sum_value
FROM g LEFT JOIN f USING (user_id, ts)"""

_ICOLS = ["invocations", "avg_value", "max_value", "sum_value"]


def _interp(c: str) -> str:
    return (f"CASE WHEN {c} IS NOT NULL THEN CAST({c} AS DOUBLE) WHEN pt IS NULL THEN NULL "
            f"WHEN nt IS NULL THEN p_{c} ELSE p_{c} + (n_{c} - p_{c}) / (nt - pt) * (us - pt) END")


def _interpolated(unit: str) -> str:
    return f"""{_grid_cte(unit)},
j AS (SELECT g.user_id, g.ts, epoch_us(g.ts) AS us, f.invocations, f.avg_value, f.max_value, f.sum_value,
             CASE WHEN f.invocations IS NOT NULL THEN epoch_us(g.ts) END AS ous
      FROM g LEFT JOIN f USING (user_id, ts)),
w AS (SELECT *, last_value(ous IGNORE NULLS) OVER wp AS pt, first_value(ous IGNORE NULLS) OVER wn AS nt,
        {", ".join(f"last_value({c} IGNORE NULLS) OVER wp AS p_{c}, first_value({c} IGNORE NULLS) OVER wn AS n_{c}" for c in _ICOLS)}
      FROM j
      WINDOW wp AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             wn AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT user_id, ts, {", ".join(f"{_interp(c)} AS {c}" for c in _ICOLS)} FROM w)"""


INTERPOLATE_TIME = f"""WITH {_interpolated('hour')}
SELECT user_id, ts, {", ".join(f"{R(c)} AS {c}" for c in _ICOLS)} FROM i"""

DATE_GRID = """
SELECT t - INTERVAL 1 HOUR AS ts
FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS t
      FROM (SELECT date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM events))"""

_DT = """(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6"""

TIME_DIFFS = f"""
SELECT event_id, user_id, ts, {R('dt')} AS dt FROM (SELECT event_id, user_id, ts, {_DT} AS dt FROM events)"""

_GAPS_H = f"SELECT user_id, {_DT} / 3600.0 AS dt_h FROM events"

GAP_STATS = f"""
SELECT user_id, count(*) AS n_gaps, {R('avg(dt_h)')} AS mean_gap_h, {R('var_samp(dt_h)')} AS var_gap_h2
FROM ({_GAPS_H}) WHERE dt_h IS NOT NULL GROUP BY user_id"""

GAP_HISTOGRAM = f"""
WITH v AS (SELECT dt_h AS v FROM ({_GAPS_H}) WHERE dt_h IS NOT NULL),
r AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
c AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 50)), 49) END AS INTEGER) AS bin,
             count(*) AS cnt
      FROM v, r GROUP BY 1),
e AS (SELECT CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / 50) AS lo, lo + (i + 1) * ((hi - lo) / 50) AS hi
      FROM r, (SELECT unnest(generate_series(0, 49)) AS i))
SELECT e.bin, {R('e.lo')} AS lo, {R('e.hi')} AS hi, coalesce(cnt, 0) AS count,
       {R('CASE WHEN cnt > 0 THEN log10(cnt) END')} AS log_count
FROM e LEFT JOIN c USING (bin)"""

KDE = f"""
WITH v AS (SELECT CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL),
st AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h
       FROM v),
p AS (SELECT unnest(generate_series(0, 63)) AS i)
SELECT CAST(i AS INTEGER) AS point, {R('lo + i * (hi - lo) / 63')} AS x,
       {R('sum(exp(-0.5 * pow((lo + i * (hi - lo) / 63 - v) / h, 2))) / (n * h * sqrt(2 * pi()))')} AS density
FROM v, p, st GROUP BY i, lo, hi, n, h"""

_WEEKS = """
wk AS (SELECT o_orderpriority,
              CAST(CAST(o_orderdate AS DATE) + CAST((7 - isodow(o_orderdate)) % 7 AS INTEGER) AS TIMESTAMP) AS o_orderdate,
              avg(o_totalprice) AS o_totalprice
       FROM orders GROUP BY 1, 2),
b AS (SELECT o_orderpriority, min(o_orderdate) AS a, max(o_orderdate) AS z FROM wk GROUP BY 1),
g AS (SELECT o_orderpriority, unnest(generate_series(a, z, INTERVAL 7 DAY)) AS o_orderdate FROM b),
x AS (SELECT g.o_orderpriority, g.o_orderdate, wk.o_totalprice FROM g LEFT JOIN wk USING (o_orderpriority, o_orderdate))"""

WEEKLY_MEAN = f"""WITH {_WEEKS}
SELECT o_orderpriority, o_orderdate, {R('o_totalprice')} AS o_totalprice FROM x"""

ROLLING_MEAN_FULL = f"""WITH {_WEEKS}
SELECT o_orderpriority, o_orderdate, {R('o_totalprice')} AS o_totalprice,
       {R('CASE WHEN count(o_totalprice) OVER w = 56 THEN avg(o_totalprice) OVER w END')} AS o_totalprice_rolling
FROM x WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate ROWS BETWEEN 55 PRECEDING AND CURRENT ROW)"""

_ROLLED = """
SELECT user_id, ts, max_value AS a1, avg(max_value) OVER w AS p1, sum_value AS a2, avg(sum_value) OVER w AS p2,
       count(*) OVER w AS k
FROM ({src}) WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""
_ROLL = _ROLLED.format(src=feats("day"))

_FORECAST_COLS = f"""user_id, ts, {R('a1')} AS actual_max_value, {R('p1')} AS predicted_max_value,
       {R('a2')} AS actual_sum_value, {R('p2')} AS predicted_sum_value"""

ROLLING_FORECAST = f"SELECT {_FORECAST_COLS} FROM ({_ROLL}) WHERE k > 0"

ROLLING_FORECAST_GRID = f"""WITH {_interpolated('day')}
SELECT {_FORECAST_COLS} FROM ({_ROLLED.format(src="i")}) WHERE k > 0"""


def _huber(e: str) -> str:
    return f"CASE WHEN abs({e}) <= 1.0 THEN 0.5 * {e} * {e} ELSE 1.0 * (abs({e}) - 0.5 * 1.0) END"


FORECAST_METRICS = f"""
WITH e AS (SELECT user_id, a1, p1, a2, p2, p1 - a1 AS e1, p2 - a2 AS e2 FROM ({_ROLL}) WHERE k > 0)
SELECT user_id, count(*) AS n, {R('avg((e1 * e1 + e2 * e2) / 2.0)')} AS loss,
       {R('avg((abs(e1) + abs(e2)) / 2.0)')} AS mae,
       {R(f'avg(({_huber("e1")} + {_huber("e2")}) / 2.0)')} AS huber,
       {R('avg(CASE WHEN sqrt(a1 * a1 + a2 * a2) = 0 OR sqrt(p1 * p1 + p2 * p2) = 0 THEN 0.0 ELSE (a1 * p1 + a2 * p2) / (sqrt(a1 * a1 + a2 * a2) * sqrt(p1 * p1 + p2 * p2)) END)')} AS cos
FROM e GROUP BY user_id"""

# --------------------------------------------------------------------------- federated

_NPOS = "len(list_filter(embedding, lambda x: x > 0))"

FEDAVG_WEIGHTS = f"""
WITH w AS (SELECT label AS round, vec_id AS client, {_NPOS} AS n,
                  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings),
l AS (SELECT round, n, 0 AS layer, w[1:32] AS weights FROM w
      UNION ALL SELECT round, n, 1 AS layer, w[33:64] AS weights FROM w),
e AS (SELECT round, layer, n, unnest(weights) AS v, unnest(generate_series(1, len(weights))) AS pos FROM l),
p AS (SELECT round, layer, pos, sum(v * n) / sum(n) AS m, sum(n) AS nt FROM e GROUP BY 1, 2, 3)
SELECT round, layer, {RL('list(m ORDER BY pos)')} AS weights, max(nt) AS n FROM p GROUP BY 1, 2"""

_PROFILE = "(((user_id - 1) % 4 + 4) % 4)"
_FED_COLS = ["invocations", "avg_value", "max_value", "sum_value"]


def _fed_sql() -> str:
    """Clients with their mini-batches in order, and one local fit as a fold of plain steps
    over them, not as a composed map: weights ``w`` (3 x 2, row by row)."""
    z = ", ".join(f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END AS {n}" for c, n in zip(_FED_COLS, ("x2", "x3", "y1", "y2"), strict=True))
    stats = ", ".join(f"avg({c}) AS m_{c}, {SD(c)} AS s_{c}" for c in _FED_COLS)
    x = ["1.0", "x2", "x3"]
    g = ", ".join(f"sum({a} * {b})" for a in x for b in x)
    c = ", ".join(f"sum({a} * {b})" for a in x for b in ("y1", "y2"))
    moves = ", ".join(f"a.w[{2 * i + t + 1}] - b.k * (" + " + ".join(f"b.g[{3 * i + j + 1}] * a.w[{2 * j + t + 1}]" for j in range(3))
                      + f" - b.c[{2 * i + t + 1}])" for i in range(3) for t in range(2))
    return f"""
f AS MATERIALIZED ({feats('hour')}),
s AS (SELECT *, CASE WHEN CAST(ts AS DATE) < max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) - 7 THEN 'train' ELSE 'test' END AS split FROM f),
pr AS (SELECT user_id, {stats} FROM s WHERE split = 'train' GROUP BY user_id),
z AS MATERIALIZED (SELECT user_id, ts, split, {z} FROM s JOIN pr USING (user_id)),
tr AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1) // [32, 256, 64, 128][{_PROFILE} + 1] AS batch FROM z WHERE split = 'train'),
bg AS (SELECT user_id, batch, count(*) AS n, [{g}] AS g, [{c}] AS c FROM tr GROUP BY user_id, batch),
cl AS MATERIALIZED (
  SELECT user_id, CAST(sum(n) AS BIGINT) AS n,
    list({{'w': [0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 'k': 2 * CAST([0.001, 0.005, 0.02, 0.09] AS DOUBLE[])[{_PROFILE} + 1] / n, 'g': g, 'c': c}} ORDER BY batch) AS steps
  FROM bg GROUP BY user_id),
fit AS (SELECT user_id, n, list_concat(steps, steps, steps, steps, steps) AS steps FROM cl)""", (
        f"list_reduce(list_concat([{{'w': WEIGHTS, 'k': 0.0::DOUBLE, 'g': [0.0::DOUBLE], 'c': [0.0::DOUBLE]}}], steps), "
        f"lambda a, b: {{'w': [{moves}], 'k': b.k, 'g': b.g, 'c': b.c}}).w")


_FED, _FIT = _fed_sql()
_ZERO = "[0.0::DOUBLE, 0.0, 0.0, 0.0, 0.0, 0.0]"


def _fed_history(server: str = "mean") -> str:
    """``r`` (round, w): the rounds by recursion; ``ev`` (round, user_id, n, loss, mae, cos): evaluations on the held-out rows."""
    mean = [f"sum(n * l[{i}]) / sum(n)" for i in range(1, 7)]
    if server == "mean":
        rounds = f"""
r AS (
  SELECT 0 AS round, {_ZERO} AS w
  UNION ALL
  SELECT round + 1, [{", ".join(mean)}] FROM (SELECT round, n, {_FIT.replace("WEIGHTS", "w")} AS l FROM r CROSS JOIN fit WHERE round < 20) GROUP BY round)"""
    else:
        v = [f"0.5 * any_value(v)[{i}] + any_value(w)[{i}] - {m}" for i, m in enumerate(mean, 1)]
        rounds = f"""
r AS (
  SELECT 0 AS round, {_ZERO} AS w, {_ZERO} AS v
  UNION ALL
  SELECT round + 1, [{", ".join(f"any_value(w)[{i}] - ({x})" for i, x in enumerate(v, 1))}], [{", ".join(v)}]
  FROM (SELECT round, n, w, v, {_FIT.replace("WEIGHTS", "w")} AS l FROM r CROSS JOIN fit WHERE round < 20) GROUP BY round)"""
    return f"""{_FED},{rounds},
p AS (SELECT round, user_id, y1, y2, w[1] + x2 * w[3] + x3 * w[5] AS p1, w[2] + x2 * w[4] + x3 * w[6] AS p2
      FROM z CROSS JOIN r WHERE split = 'test' AND round > 0),
ev AS (
  SELECT round, user_id, count(*) AS n, avg(((p1 - y1) * (p1 - y1) + (p2 - y2) * (p2 - y2)) / 2) AS loss,
    avg((abs(p1 - y1) + abs(p2 - y2)) / 2) AS mae,
    avg(CASE WHEN (y1 = 0 AND y2 = 0) OR (p1 = 0 AND p2 = 0) THEN 0.0
             ELSE (y1 * p1 + y2 * p2) / (sqrt(y1 * y1 + y2 * y2) * sqrt(p1 * p1 + p2 * p2)) END) AS cos
  FROM p GROUP BY round, user_id),
m AS (
  SELECT round, count(*) AS clients, CAST(sum(n) AS BIGINT) AS n, sum(loss * n) / sum(n) AS loss, sum(cos * n) / sum(n) AS cos, sum(mae * n) / sum(n) AS mae
  FROM ev GROUP BY round)"""


def _flat_weights(w: str) -> str:
    return RL(f"list_transform({w}, lambda q: round(q, 12))")


def _fed_rounds(server: str) -> str:
    return f"""WITH RECURSIVE {_fed_history(server)}
SELECT round, (SELECT CAST(sum(n) AS BIGINT) FROM cl) AS n, {_flat_weights('w')} AS weights, clients,
  {R('loss')} AS loss, {R('cos')} AS cos, {R('mae')} AS mae
FROM r JOIN m USING (round)"""


FED_ROUNDS, FED_MOMENTUM = _fed_rounds("mean"), _fed_rounds("momentum")

FED_LOCAL_FIT = f"""WITH {_FED}
SELECT user_id, n, {_flat_weights('l')} AS weights FROM (SELECT user_id, n, {_FIT.replace("WEIGHTS", _ZERO)} AS l FROM fit)"""

FED_TRIMMED_ROUND = f"""WITH {_FED},
l AS (SELECT {_FIT.replace("WEIGHTS", _ZERO)} AS l FROM fit),
u AS (SELECT unnest(l) AS w, unnest(range(1, 7)) AS pos FROM l),
o AS (SELECT pos, w, row_number() OVER (PARTITION BY pos ORDER BY w) AS rn, count(*) OVER (PARTITION BY pos) AS k FROM u),
t AS (SELECT pos, avg(w) AS w FROM o WHERE rn > floor(0.1 * k) AND rn <= k - floor(0.1 * k) GROUP BY pos)
SELECT 1 AS round, {_flat_weights('list(w ORDER BY pos)')} AS weights FROM t"""

FED_EVALUATE = f"""WITH RECURSIVE {_fed_history()}
SELECT user_id, n, {R('loss')} AS loss, {R('mae')} AS mae, {R('cos')} AS cos FROM ev WHERE round = 20"""

FEDAVG_METRICS = f"""WITH RECURSIVE {_fed_history()}
SELECT round, clients, n, {R('loss')} AS loss, {R('cos')} AS cos, {R('mae')} AS mae FROM m"""


def _gauges(src: str) -> str:
    parts = [f"SELECT '{g}' AS name, make_timestamp(CAST(round AS BIGINT) * 1000000) AS ts, {R(c)} AS value FROM {src}"
             for g, c in (("model_loss", "loss"), ("model_cosine_similarity", "cos"),
                          ("model_mean_absolute_error", "mae"))]
    return "\nUNION ALL\n".join(parts)


GAUGE_LATEST = f"""WITH RECURSIVE {_fed_history()},
last AS (SELECT * FROM m WHERE round = (SELECT max(round) FROM m))
{_gauges('last')}"""

STREAM_GAUGES = f"""WITH RECURSIVE {_fed_history()}
{_gauges('m')}"""

FED_ROUND_ONE = f"""
WITH f AS ({feats('day')}),
p AS (SELECT user_id, avg(invocations) AS mi, {SD('invocations')} AS si,
             avg(avg_value) AS ma, {SD('avg_value')} AS sa,
             avg(max_value) AS mx, {SD('max_value')} AS sx FROM f GROUP BY 1),
z AS (SELECT CASE WHEN si = 0 THEN 0.0 ELSE (invocations - mi) / si END AS x1,
             CASE WHEN sa = 0 THEN 0.0 ELSE (avg_value - ma) / sa END AS x2,
             CASE WHEN sx = 0 THEN 0.0 ELSE (max_value - mx) / sx END AS y
      FROM f JOIN p USING (user_id))
SELECT 1 AS round,
       {_flat_weights('[2 * 0.1 * sum(y) / count(*), 2 * 0.1 * sum(x1 * y) / count(*), 2 * 0.1 * sum(x2 * y) / count(*)]')} AS weights,
       count(*) AS n
FROM z"""

CLIENT_PROFILES = f"""
SELECT user_id, CAST({_PROFILE} AS INTEGER) AS profile,
       {R(f'CAST([0.001, 0.005, 0.02, 0.09] AS DOUBLE[])[{_PROFILE} + 1]')} AS learning_rate,
       [32, 256, 64, 128][{_PROFILE} + 1] AS batch_size
FROM (SELECT DISTINCT user_id FROM events)"""

# --------------------------------------------------------------------------- ARX

_LAGS = f"""
SELECT user_id, ts, sum_value AS y, lag(sum_value, 1) OVER w AS y1, lag(sum_value, 2) OVER w AS y2,
       invocations AS x, lag(invocations, 1) OVER w AS x1, lag(invocations, 2) OVER w AS x2
FROM ({feats('day')}) WINDOW w AS (PARTITION BY user_id ORDER BY ts)"""

AR1_DIFF = f"""
WITH d AS (SELECT user_id, y - y1 AS dy, y1 - y2 AS dy1 FROM ({_LAGS}) WHERE y2 IS NOT NULL)
SELECT user_id, count(*) AS n,
       {R('CASE WHEN sum(dy1 * dy1) <> 0 THEN sum(dy * dy1) / sum(dy1 * dy1) ELSE 0.0 END')} AS phi
FROM d GROUP BY user_id"""

SARIMAX_CLS = f"""
WITH d AS (SELECT user_id, y - y1 AS dy, y1 - y2 AS dy1, CAST(x - x1 AS DOUBLE) AS dx, CAST(x1 - x2 AS DOUBLE) AS dx1
           FROM ({_LAGS}) WHERE y2 IS NOT NULL AND x2 IS NOT NULL),
s AS (SELECT user_id, count(*) AS n, sum(dy * dy1) AS yy1, sum(dy1 * dy1) AS y1y1, sum(dx * dx) AS xx,
             sum(dx * dy) AS xy, sum(dx * dy1) AS xy1, sum(dx1 * dy) AS x1y, sum(dx1 * dy1) AS x1y1,
             sum(dx * dx1) AS xx1, sum(dx1 * dx1) AS x1x1
      FROM d GROUP BY 1),
b AS (SELECT *, CASE WHEN xx <> 0 THEN xy / xx ELSE 0.0 END AS b0 FROM s),
p AS (SELECT *, yy1 - b0 * x1y - b0 * xy1 + b0 * b0 * xx1 AS num,
             y1y1 - 2 * b0 * x1y1 + b0 * b0 * x1x1 AS den FROM b),
q AS (SELECT *, CASE WHEN den <> 0 THEN num / den ELSE 0.0 END AS phi FROM p)
SELECT user_id, n, {R('phi')} AS phi,
       {R('CASE WHEN xx - 2 * phi * xx1 + phi * phi * x1x1 <> 0 THEN (xy - phi * xy1 - phi * x1y + phi * phi * x1y1) / (xx - 2 * phi * xx1 + phi * phi * x1x1) ELSE 0.0 END')} AS beta
FROM q"""



def _huber_windows() -> str:
    z = ", ".join(f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END AS {n}" for c, n in zip(_FED_COLS, ("x2", "x3", "y1", "y2"), strict=True))
    stats = ", ".join(f"avg({c}) AS m_{c}, {SD(c)} AS s_{c}" for c in _FED_COLS)
    x = ("1.0", "x2", "x3")
    sums = ", ".join(f"sum(k * {x[i]} * {x[j]}) AS g{i}{j}" for i in range(3) for j in range(3)) + ", " + ", ".join(f"sum(k * {x[i]} * y) AS c{i}" for i in range(3))

    def det(*cols):
        g = [[(f"c{i}" if c == "c" else f"g{i}{c}") for c in cols] for i in range(3)]
        return (f"({g[0][0]} * ({g[1][1]} * {g[2][2]} - {g[1][2]} * {g[2][1]}) - {g[0][1]} * ({g[1][0]} * {g[2][2]} - {g[1][2]} * {g[2][0]})"
                f" + {g[0][2]} * ({g[1][0]} * {g[2][1]} - {g[1][1]} * {g[2][0]}))")
    d = det(0, 1, 2)
    return f"""WITH RECURSIVE f AS ({feats('day')}),
pr AS (SELECT user_id, {stats} FROM f GROUP BY user_id),
z AS (SELECT user_id, {z}, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM f JOIN pr USING (user_id)),
w AS (SELECT x2, x3, y1, y2, unnest(generate_series(greatest(1, rn - 6), least(rn, n - 6))) AS s FROM z),
dd AS MATERIALIZED (SELECT 'max_value' AS target, x2, x3, y1 AS y FROM w UNION ALL SELECT 'sum_value', x2, x3, y2 FROM w),
it AS (
  SELECT 0 AS step, target, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM (SELECT DISTINCT target FROM dd)
  UNION ALL
  SELECT step + 1, target, {det("c", 1, 2)} / {d}, {det(0, "c", 2)} / {d}, {det(0, 1, "c")} / {d}
  FROM (SELECT step, target, {sums}
        FROM (SELECT *, CASE WHEN abs(e) <= 1 THEN 1.0 ELSE 1.0 / abs(e) END AS k
              FROM (SELECT step, dd.*, y - w0 - w1 * x2 - w2 * x3 AS e FROM it JOIN dd USING (target) WHERE step < 80))
        GROUP BY step, target)),
l AS (SELECT target, any_value([w0, w1, w2]) AS weights, count(*) AS n,
        avg(CASE WHEN abs(y - w0 - w1 * x2 - w2 * x3) <= 1 THEN 0.5 * pow(y - w0 - w1 * x2 - w2 * x3, 2) ELSE abs(y - w0 - w1 * x2 - w2 * x3) - 0.5 END) AS loss
      FROM it JOIN dd USING (target) WHERE step = 80 GROUP BY target)
SELECT target, {RL('list_transform(weights, lambda q: round(q, 10))')} AS weights, {R('loss')} AS loss, n, 0 AS n_left_out FROM l"""


HUBER_WINDOWS = _huber_windows()


_Z, _Z1 = ("dy", "dx0", "dx1"), ("py", "px0", "px1")
_PAIRS = [(i, j) for i in range(3) for j in range(3)]


def _quadratic(m: str) -> str:
    """v' M v for v = [1, -b0, -b1] and the moments ``{m}ij``."""
    v = ("1", "(-b0)", "(-b1)")
    return " + ".join(f"{v[i]} * {v[j]} * {m}{i}{j}" for i, j in _PAIRS)


def _arx(src: str) -> str:
    """``p`` (user_id, target, n, phi, b0, b1, a, b, c): exact AR(1) likelihood of the differences in ``src``, by 400
    rounds of normal equations (Cramer's rule) and bisection of the cubic; ``u`` are the differences."""
    q = {(i, j): f"(w{i}{j} - phi * (n{i}{j} + n{j}{i}) + phi * phi * c{i}{j})" for i, j in _PAIRS}
    det = f"({q[1, 1]} * {q[2, 2]} - {q[1, 2]} * {q[2, 1]})"
    solved = (f"({q[1, 0]} * {q[2, 2]} - {q[1, 2]} * {q[2, 0]}) / {det} AS b0, "
              f"({q[1, 1]} * {q[2, 0]} - {q[2, 1]} * {q[1, 0]}) / {det} AS b1")
    root = ("list_reduce(list_concat([{'lo': -1.0::DOUBLE, 'hi': 1.0::DOUBLE}], list_transform(range(60), lambda k: {'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE})), "
            "lambda s, k: CASE WHEN ((n - 1) * c * ((s.lo + s.hi) / 2) - (n - 2) * b) * ((s.lo + s.hi) / 2) * ((s.lo + s.hi) / 2) "
            "- (n * c + a) * ((s.lo + s.hi) / 2) + n * b > 0 THEN {'lo': (s.lo + s.hi) / 2, 'hi': s.hi} ELSE {'lo': s.lo, 'hi': (s.lo + s.hi) / 2} END)")
    keep = "user_id, target, n, phi, " + ", ".join(f"{m}{i}{j}" for m in "wnc" for i, j in _PAIRS)
    lags = ", ".join(f"{x} - lag({x}) OVER o AS {d}" for x, d in zip(("y", "invocations", "avg_value"), _Z, strict=True))
    return f"""
u0 AS (SELECT *, {lags} FROM ({src}) WINDOW o AS (PARTITION BY user_id, target ORDER BY ts)),
u AS MATERIALIZED (
  SELECT *, {", ".join(f"lag({d}) OVER o AS {e}" for d, e in zip(_Z, _Z1, strict=True))}, row_number() OVER o AS pos, count(*) OVER (PARTITION BY user_id, target) AS m
  FROM u0 WHERE dy IS NOT NULL WINDOW o AS (PARTITION BY user_id, target ORDER BY ts)),
mo AS MATERIALIZED (
  SELECT user_id, target, count(*) AS n, 0.0::DOUBLE AS phi, {", ".join(f"sum({_Z[i]} * {_Z[j]}) AS w{i}{j}" for i, j in _PAIRS)},
    {", ".join(f"coalesce(sum({_Z[i]} * {_Z1[j]}), 0.0) AS n{i}{j}" for i, j in _PAIRS)},
    {", ".join(f"coalesce(sum(CASE WHEN pos > 1 AND pos < m THEN {_Z[i]} * {_Z[j]} END), 0.0) AS c{i}{j}" for i, j in _PAIRS)}
  FROM u GROUP BY user_id, target),
it AS (
  SELECT 0 AS step, {keep} FROM mo
  UNION ALL
  SELECT step + 1, {keep.replace("phi", "(r.lo + r.hi) / 2 AS phi", 1)}
  FROM (SELECT *, {root} AS r
        FROM (SELECT *, {_quadratic("w")} AS a, {_quadratic("n")} AS b, {_quadratic("c")} AS c FROM (SELECT *, {solved} FROM it WHERE step < 400)))),
p AS (SELECT user_id, target, n, phi, b0, b1, {_quadratic("w")} - 2 * phi * ({_quadratic("n")}) + phi * phi * ({_quadratic("c")}) AS s
      FROM (SELECT *, {solved} FROM it WHERE step = 400))"""


_BOTH = "\n  UNION ALL ".join(f"SELECT user_id, '{t}' AS target, ts, {t} AS y, invocations, avg_value FROM {{src}}" for t in ("max_value", "sum_value"))

ARX_FIT = f"""WITH RECURSIVE {_interpolated('day')},
{_arx(_BOTH.format(src="i"))},
e AS (SELECT user_id, target, avg(abs(dy - phi * py - b0 * (dx0 - phi * px0) - b1 * (dx1 - phi * px1))) AS mae
      FROM u JOIN p USING (user_id, target) GROUP BY user_id, target)
SELECT user_id, target, n, {R('phi')} AS phi, {RL('[b0, b1]')} AS beta, {R('s / n')} AS sigma2,
  {R('-n / 2 * (ln(2 * pi() * s / n) + 1) + ln(1 - phi * phi) / 2')} AS loglik, {R('mae')} AS mae
FROM p JOIN e USING (user_id, target)"""

_ARX_FORECAST = f"""WITH RECURSIVE {_interpolated('day')},
h AS MATERIALIZED (SELECT *, CAST(ts AS DATE) < max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) - 7 AS train FROM i),
{_arx(_BOTH.format(src="h WHERE train"))},
l AS (SELECT * FROM u WHERE pos = m),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, target ORDER BY ts) AS h FROM ({_BOTH.format(src="h WHERE NOT train")})),
fc AS (
  SELECT t.user_id, t.target, t.h, t.ts, t.y AS actual,
    b0 * t.invocations + b1 * t.avg_value + (l.y - b0 * l.invocations - b1 * l.avg_value)
      + (l.dy - b0 * l.dx0 - b1 * l.dx1) * phi * (1 - pow(phi, t.h)) / (1 - phi) AS forecast
  FROM t JOIN p USING (user_id, target) JOIN l USING (user_id, target))"""

ARX_FORECAST = f"""{_ARX_FORECAST}
SELECT user_id, target, h, ts, {R('actual')} AS actual, {R('forecast')} AS forecast FROM fc"""

_PICKED = ", ".join(R(f"max(CASE WHEN target = '{t}' THEN {c} END)") + f" AS {n}_{t}" for t in ("max_value", "sum_value") for n, c in (("actual", "actual"), ("predicted", "forecast")))

PREDICTION_TABLE = f"""{_ARX_FORECAST}
SELECT user_id, ts, {_PICKED} FROM fc WHERE h <= 6 GROUP BY user_id, ts"""

# --------------------------------------------------------------------------- metric queries

_STEP, _RANGE = 3_600_000_000, 86_400_000_000
_NOW = "TIMESTAMP '2024-01-15 12:00:00'"

_SAMPLES = """
ev AS (SELECT e.event_id, e.user_id, e.ts, e.value, c.c_mktsegment, n.n_name
       FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
cpu AS (SELECT *, sum(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM ev)"""

_RATE = f"""
d AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY ts) AS pv FROM cpu),
i AS (SELECT user_id, c_mktsegment, n_name, epoch_us(ts) AS us,
             CASE WHEN pv IS NULL THEN 0.0 WHEN v < pv THEN v ELSE v - pv END AS inc FROM d),
x AS (SELECT *, unnest(generate_series((us + {_STEP - 1}) // {_STEP}, (us + {_RANGE - 1}) // {_STEP})) AS k FROM i),
r AS (SELECT user_id, c_mktsegment, n_name, k,
             (sum(inc) - arg_min(inc, us)) / ((max(us) - min(us)) / 1e6) AS rate
      FROM x WHERE k * {_STEP} < us + {_RANGE}
      GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2 AND max(us) > min(us))"""

COUNTER_RATE = f"""WITH {_SAMPLES}, {_RATE}
SELECT 'container_cpu_usage_seconds_total' AS name, n_name AS instance, c_mktsegment AS container,
       CAST(user_id AS VARCHAR) AS id, make_timestamp(k * {_STEP}) AS ts, {R('rate')} AS value
FROM r"""

_KEEP = "NOT regexp_full_match(c_mktsegment, '(BUILDING|FURNITURE)') AND regexp_full_match(c_mktsegment, '.+')"

CPU_BY_NAME = f"""WITH {_SAMPLES}, {_RATE}
SELECT make_timestamp(k * {_STEP}) AS ts, c_mktsegment AS name, {R('sum(rate) * 100.0')} AS value
FROM r WHERE {_KEEP} GROUP BY k, c_mktsegment"""

MEMORY_BY_NAME = f"""WITH {_SAMPLES},
x AS (SELECT user_id, c_mktsegment, epoch_us(ts) AS us, value,
             unnest(generate_series((epoch_us(ts) + {_STEP - 1}) // {_STEP}, (epoch_us(ts) + {_STEP}) // {_STEP})) AS k
      FROM ev WHERE {_KEEP}),
lv AS (SELECT user_id, c_mktsegment, k, arg_max(value, us) AS v FROM x WHERE k * {_STEP} <= us + {_STEP} GROUP BY 1, 2, 3)
SELECT make_timestamp(k * {_STEP}) AS ts, c_mktsegment AS name, {R('sum(v)')} AS value FROM lv GROUP BY k, c_mktsegment"""

_PROPS = "TRY_CAST(regexp_extract(e.props, '[0-9]+') AS DOUBLE)"


def _containers(value: str) -> str:
    return f"""ev AS (SELECT e.event_id, e.user_id, e.ts, {value} AS value, c.c_mktsegment, n.n_name
       FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


def _bytes(value: str, direction: str) -> str:
    return f"""SELECT * FROM (WITH {_containers(value)},
cpu AS (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM ev), {_RATE}
SELECT make_timestamp(k * {_STEP}) AS ts, c_mktsegment AS name, {R('sum(rate)')} AS value, '{direction}' AS direction
FROM r WHERE {_KEEP} GROUP BY k, c_mktsegment)"""


NETWORK_BY_NAME = _bytes("e.value", "received") + " UNION ALL " + _bytes(_PROPS, "sent")

CACHE_BY_NAME = f"""WITH {_containers(_PROPS)},
x AS (SELECT user_id, c_mktsegment, epoch_us(ts) AS us, value,
             unnest(generate_series((epoch_us(ts) + {_STEP - 1}) // {_STEP}, (epoch_us(ts) + {_STEP}) // {_STEP})) AS k
      FROM ev WHERE {_KEEP}),
lv AS (SELECT user_id, c_mktsegment, k, arg_max(value, us) AS v FROM x WHERE k * {_STEP} <= us + {_STEP} GROUP BY 1, 2, 3)
SELECT make_timestamp(k * {_STEP}) AS ts, c_mktsegment AS name, {R('sum(v)')} AS value FROM lv GROUP BY k, c_mktsegment"""

LABEL_FILTER = f"""WITH {_SAMPLES}
SELECT 'container_memory_rss' AS name, n_name AS instance, c_mktsegment AS container, CAST(user_id AS VARCHAR) AS id,
       ts, {R('value')} AS value
FROM ev WHERE regexp_full_match(n_name, 'NATION_(1|2|3)') AND NOT regexp_full_match(c_mktsegment, 'AUTO.*')"""

LABEL_VALUES = f"""WITH {_SAMPLES} SELECT DISTINCT n_name AS instance FROM ev"""

LABEL_VALUES_DEPENDENT = f"""WITH {_SAMPLES}
SELECT DISTINCT c_mktsegment AS name FROM ev WHERE regexp_full_match(n_name, 'NATION_1.*')"""

_DAYSTART = """
ds AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS st FROM ev GROUP BY 1, 2),
full_s AS (SELECT ev.*, cpu.v AS cpu_v, ds.st,
                  sum(ev.value) OVER (PARTITION BY ev.user_id ORDER BY ev.ts, ev.event_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rx
           FROM ev JOIN cpu USING (event_id) JOIN ds ON ev.user_id = ds.user_id AND CAST(ev.ts AS DATE) = ds.day)"""

INSTANT_INFO = f"""WITH {_SAMPLES}, {_DAYSTART},
l AS (SELECT user_id, n_name, c_mktsegment, max(ts) AS ts,
             arg_max(CAST(epoch_us(st) // 1000000 AS DOUBLE), ts) AS v
      FROM full_s WHERE ts <= {_NOW} GROUP BY 1, 2, 3)
SELECT n_name AS host, c_mktsegment AS container, CAST(user_id AS VARCHAR) AS id, ts,
       {R(f"(epoch_us({_NOW}) // 1000000 - v) / 86400.0")} AS age_days
FROM l"""

RECENT = f"""WITH {_SAMPLES}, {_DAYSTART},
w AS (SELECT * FROM full_s WHERE ts > {_NOW} - INTERVAL 15 MINUTE AND ts <= {_NOW})
SELECT name, n_name AS instance, c_mktsegment AS container, CAST(user_id AS VARCHAR) AS id, ts, {R('value')} AS value
FROM (SELECT 'container_cpu_usage_seconds_total' AS name, n_name, c_mktsegment, user_id, ts, cpu_v AS value FROM w
      UNION ALL SELECT 'container_network_receive_bytes_total', n_name, c_mktsegment, user_id, ts, rx FROM w
      UNION ALL SELECT 'container_memory_rss', n_name, c_mktsegment, user_id, ts, value FROM w
      UNION ALL SELECT 'container_start_time_seconds', n_name, c_mktsegment, user_id, ts,
                       CAST(epoch_us(st) // 1000000 AS DOUBLE) FROM w)"""

# --------------------------------------------------------------------------- streaming (closed windows)

STREAM_FEATURES = f"""
SELECT user_id, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       count(*) AS invocations, {R('avg(value)')} AS avg_value, {R('max(value)')} AS max_value,
       {R('sum(value)')} AS sum_value
FROM events GROUP BY 1, 2, 3"""

STREAM_RATE = f"""WITH {_SAMPLES}, {_RATE}
SELECT 'container_cpu_usage_seconds_total' AS name, n_name AS instance, c_mktsegment AS container,
       CAST(user_id AS VARCHAR) AS id, make_timestamp(k * {_STEP}) AS window_end, {R('rate')} AS value
FROM r"""


# --------------------------------------------------------------------------- predictions, cuts, slices

PREDICTIONS_INVERSE = f"""
SELECT user_id, ts, {R('a1')} AS actual_max_value, {R('p1')} AS predicted_max_value,
       {R('a2')} AS actual_sum_value, {R('p2')} AS predicted_sum_value
FROM ({_ROLL}) WHERE k > 0"""

TIME_CUT = f"""
SELECT event_id, user_id, ts, {R('value')} AS value,
       CASE WHEN ts < TIMESTAMP '2024-01-15 12:00:00' THEN 'train' ELSE 'val' END AS split
FROM events"""

TIME_SLICE = f"""
SELECT o_orderkey, o_orderdate, {R('o_totalprice')} AS o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00'"""


TIME_SLICE_INCLUSIVE = f"""
SELECT o_orderkey, o_orderdate, {R('o_totalprice')} AS o_totalprice FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1998-12-31 00:00:00'"""

TIME_STRINGS = """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, date_trunc('millisecond', ts) - INTERVAL 2 HOUR AS instant,
       date_trunc('second', ts) AS wall, date_trunc('hour', ts) AS hour
FROM events"""

COUNTER_RATE_SAMPLES = f"""WITH {_SAMPLES},
d AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY ts) AS pv FROM cpu),
i AS (SELECT user_id, c_mktsegment, n_name, ts, epoch_us(ts) AS us,
             CASE WHEN pv IS NULL THEN 0.0 WHEN v < pv THEN v ELSE v - pv END AS inc FROM d),
r AS (SELECT *, count(*) OVER w AS n, min(us) OVER w AS t0, sum(inc) OVER w AS s, first_value(inc) OVER w AS i0
      FROM i WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {6 * 3600 * 1_000_000 - 1} PRECEDING AND CURRENT ROW))
SELECT 'container_cpu_usage_seconds_total' AS name, n_name AS instance, c_mktsegment AS container,
       CAST(user_id AS VARCHAR) AS id, ts, {R('(s - i0) / ((us - t0) / 1e6)')} AS value
FROM r WHERE n >= 2 AND us > t0"""


_TIN = ["invocations", "avg_argument_size", "avg_loc", "avg_cyc_complexity", "avg_num_of_imports"]
_TOUT = ["avg_total_execution_time", "avg_system_processing_time"]
_TCOLS = _TIN + _TOUT

TASK_WINDOWS = f"""WITH {TASKS},{ENDPOINTS},{CLEAN},
f AS (SELECT endpoint_uuid, date_trunc('second', "timestamp") AS ts, count(*) AS invocations,
             avg(loc) AS avg_loc, avg(cyc_complexity) AS avg_cyc_complexity,
             avg(num_of_imports) AS avg_num_of_imports, avg(argument_size) AS avg_argument_size,
             avg(total_execution_time) AS avg_total_execution_time,
             avg(scheduling_time + queue_time + execution_time) AS avg_system_processing_time
      FROM clean GROUP BY 1, 2),
top AS (SELECT endpoint_uuid FROM f GROUP BY 1 ORDER BY count(*) DESC, endpoint_uuid LIMIT 10),
sp AS (SELECT f.*, CASE WHEN CAST(ts AS DATE) < max(CAST(ts AS DATE)) OVER (PARTITION BY endpoint_uuid) - 365
                        THEN 'train' ELSE 'test' END AS split
       FROM f WHERE endpoint_uuid IN (SELECT endpoint_uuid FROM top)),
p AS (SELECT endpoint_uuid, {", ".join(f"{SD(c)} AS s_{c}" for c in _TCOLS)}
      FROM sp WHERE split = 'train' GROUP BY 1),
sc AS (SELECT endpoint_uuid, split, ts,
         {", ".join(f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE {c} / s_{c} END AS {c}" for c in _TCOLS)}
       FROM sp LEFT JOIN p USING (endpoint_uuid)),
w AS (SELECT endpoint_uuid, split, list(ts) OVER win AS tl,
             {", ".join(f"list({c}) OVER win AS l_{c}" for c in _TCOLS)}
      FROM sc WINDOW win AS (PARTITION BY endpoint_uuid, split ORDER BY ts
                             ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING))
SELECT endpoint_uuid, split, list_transform(tl[1:7], lambda v: epoch_us(v)) AS ts_seq,
       {", ".join(f"{RL(f'l_{c}[1:7]')} AS {c}_seq" for c in _TIN)},
       list_transform(tl[8:14], lambda v: epoch_us(v)) AS ts_target,
       {", ".join(f"{RL(f'l_{c}[8:14]')} AS {c}_target" for c in _TOUT)}
FROM w WHERE len(tl) = 14"""


def _ar1_target(t: str) -> str:
    return f"""
SELECT user_id, '{t}' AS target, count(*) AS n,
       {R('CASE WHEN sum(dy1 * dy1) <> 0 THEN sum(dy * dy1) / sum(dy1 * dy1) ELSE 0.0 END')} AS phi
FROM (SELECT user_id, y - y1 AS dy, y1 - y2 AS dy1
      FROM (SELECT user_id, {t} AS y, lag({t}, 1) OVER w AS y1, lag({t}, 2) OVER w AS y2
            FROM ({feats('day')}) WINDOW w AS (PARTITION BY user_id ORDER BY ts))
      WHERE y2 IS NOT NULL)
GROUP BY user_id"""


AR1_BOTH_TARGETS = "\nUNION ALL\n".join(_ar1_target(t) for t in ("max_value", "sum_value"))


ORACLE = {
    "training_windows": TRAINING_WINDOWS,
    "star_clean": STAR_CLEAN,
    "stage_durations": STAGE_DURATIONS,
    "task_features": TASK_FEATURES,
    "workload_features": WORKLOAD_FEATURES,
    "top_series": TOP_SERIES,
    "one_hot_type": ONE_HOT_TYPE,
    "distinct_values": DISTINCT_VALUES,
    "melt_nonzero": MELT_NONZERO,
    "melt_chain": MELT_CHAIN,
    "seeded_shuffle": SEEDED_SHUFFLE,
    "sample_fraction": SAMPLE_FRACTION,
    "time_holdout": TIME_HOLDOUT,
    "time_holdout_global": TIME_HOLDOUT_GLOBAL,
    "tail_holdout": TAIL_HOLDOUT,
    "shards": SHARDS,
    "shards_global": SHARDS_GLOBAL,
    "last_n": LAST_N,
    "concat_splits": CONCAT_SPLITS,
    "scale_fit": SCALE_FIT,
    "scale_apply": SCALE_APPLY,
    "xy_matrices": XY_MATRICES,
    "time_slice_inclusive": TIME_SLICE_INCLUSIVE,
    "time_strings": TIME_STRINGS,
    "publish_chain": PUBLISH_CHAIN,
    "bucketed_features": BUCKETED_FEATURES,
    "csv_read_back": CSV_READ_BACK,
    "scale_inverse": SCALE_INVERSE,
    "sequences_future": SEQUENCES_FUTURE,
    "sequences_same": SEQUENCES_SAME,
    "first_of_sequence": FIRST_OF_SEQUENCE,
    "stack_steps": STACK_STEPS,
    "regular_grid": REGULAR_GRID,
    "interpolate_time": INTERPOLATE_TIME,
    "date_grid": DATE_GRID,
    "time_diffs": TIME_DIFFS,
    "gap_stats": GAP_STATS,
    "gap_histogram": GAP_HISTOGRAM,
    "kde": KDE,
    "weekly_mean": WEEKLY_MEAN,
    "rolling_mean_full": ROLLING_MEAN_FULL,
    "rolling_forecast": ROLLING_FORECAST,
    "forecast_metrics": FORECAST_METRICS,
    "fedavg_weights": FEDAVG_WEIGHTS,
    "fedavg_metrics": FEDAVG_METRICS,
    "gauge_latest": GAUGE_LATEST,
    "fed_round_one": FED_ROUND_ONE,
    "fed_local_fit": FED_LOCAL_FIT,
    "fed_rounds": FED_ROUNDS,
    "fed_momentum": FED_MOMENTUM,
    "fed_trimmed_round": FED_TRIMMED_ROUND,
    "fed_evaluate": FED_EVALUATE,
    "client_profiles": CLIENT_PROFILES,
    "ar1_diff": AR1_DIFF,
    "sarimax_cls": SARIMAX_CLS,
    "counter_rate": COUNTER_RATE,
    "cpu_by_name": CPU_BY_NAME,
    "memory_by_name": MEMORY_BY_NAME,
    "network_by_name": NETWORK_BY_NAME,
    "cache_by_name": CACHE_BY_NAME,
    "label_filter": LABEL_FILTER,
    "label_values": LABEL_VALUES,
    "label_values_dependent": LABEL_VALUES_DEPENDENT,
    "instant_info": INSTANT_INFO,
    "recent": RECENT,
    "stream_features": STREAM_FEATURES,
    "stream_rate": STREAM_RATE,
    "stream_gauges": STREAM_GAUGES,
    "predictions_inverse": PREDICTIONS_INVERSE,
    "time_cut": TIME_CUT,
    "time_slice": TIME_SLICE,
    "counter_rate_samples": COUNTER_RATE_SAMPLES,
    "task_windows": TASK_WINDOWS,
    "ar1_both_targets": AR1_BOTH_TARGETS,
    "arx_fit": ARX_FIT,
    "huber_windows": HUBER_WINDOWS,
    "arx_forecast": ARX_FORECAST,
    "prediction_table": PREDICTION_TABLE,
    "rolling_forecast_grid": ROLLING_FORECAST_GRID,
}
