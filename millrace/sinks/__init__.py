"""Sinks: a spec {type: ..., ...} takes a DataFrame."""

from millrace.sinks.base import Sink, SinkConfig, sink_for

__all__ = ["Sink", "SinkConfig", "sink_for"]
