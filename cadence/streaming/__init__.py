"""Structured Streaming queries."""

from cadence.streaming.live import (  # noqa: F401
    source, stream_features, stream_panes, stream_gauges, run_to_latest, run_to_table,
)
