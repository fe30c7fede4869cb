"""Scalar column expressions (JVM-side, codegen'd)."""

from cadence.functions.time import (  # noqa: F401
    ns_to_seconds, ns_to_timestamp, time_parts, second_string, parse_iso_offset,
    parse_wall_clock, parse_hour_string, epoch_us,
    week_ending_sunday, bucket_start,
)
from cadence.functions.names import one_hot_name, category_columns  # noqa: F401
from cadence.functions.labels import label, label_match  # noqa: F401
from cadence.functions.arrays import dot  # noqa: F401
