"""Readers, derived inputs and sinks."""

from cadence.sources.tables import load, read_csv, read_csv_checked, read_splits, as_instants, TABLES  # noqa: F401
from cadence.sources.sinks import write_table, export_single_file, append_gauges  # noqa: F401
from cadence.sources.versions import bucketed_join, drop_versions, publish, published, versions, write_bucketed  # noqa: F401
