"""Pipelines as specs and as chains of calls."""
