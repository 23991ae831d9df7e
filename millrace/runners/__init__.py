"""Runners: a spec is run as a batch, an increment or a stream."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession

from millrace.plans.spec import PipelineSpec
from millrace.runners.batch import BatchRunner
from millrace.runners.incremental import IncrementalRunner
from millrace.runners.stream import StreamingRunner

RUNNERS = {"batch": BatchRunner, "incremental": IncrementalRunner, "streaming": StreamingRunner}


def run(spark: SparkSession, config: Mapping[str, Any]) -> dict[str, Any]:
    spec = PipelineSpec.of(config)
    return RUNNERS[spec.mode](spark).run(spec)


__all__ = ["BatchRunner", "IncrementalRunner", "StreamingRunner", "run"]
