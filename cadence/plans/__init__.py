"""End-to-end compositions of the operators."""

from cadence.plans.training import training_windows, event_features  # noqa: F401
