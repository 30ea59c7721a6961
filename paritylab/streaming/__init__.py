"""Structured Streaming use of the contingency audit (no reference capability)."""

from paritylab.streaming.audit import stream_fairness_counts, metrics_from_stream_counts

__all__ = ["stream_fairness_counts", "metrics_from_stream_counts"]
