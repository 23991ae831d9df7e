"""Structured Streaming: transforms, triggers, sinks and metrics."""
