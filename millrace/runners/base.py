"""What runners share: state files, callbacks, retries and a session that stays its owner's."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import SparkSession

from millrace.plans.spec import PipelineSpec
from millrace.retry import retried
from millrace.storage import read_text, write_text

log = logging.getLogger(__name__)


class State:
    """A JSON file for each pipeline on any file system that Spark can write, replaced as a whole; without a
    folder nothing is kept."""

    def __init__(self, spark: SparkSession, folder: str | None, pipeline_id: str) -> None:
        self.spark, self.file = spark, f"{folder.rstrip('/')}/{pipeline_id}.json" if folder else None

    def load(self) -> dict[str, Any]:
        return json.loads(read_text(self.spark, self.file) or "{}") if self.file else {}

    def save(self, **entries: Any) -> None:
        if self.file:
            write_text(self.spark, self.file, json.dumps(self.load() | entries, default=str))


class Runner:
    """Subclasses implement _run(spec) -> metrics. The session is never stopped."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.callbacks: list[Callable[[dict[str, Any]], None]] = []

    def on_completion(self, callback: Callable[[dict[str, Any]], None]) -> Runner:
        self.callbacks.append(callback)
        return self

    def _run(self, spec: PipelineSpec) -> dict[str, Any]:
        raise NotImplementedError

    @staticmethod
    def repeatable(spec: PipelineSpec) -> bool:
        """Whether a run that failed half-way can be run again as a whole: not if it appends."""
        return spec.mode != "batch" or spec.target.get("mode", "append") in ("overwrite", "merge", "ignore") or bool(spec.target.get("replace_where"))

    def run(self, config: PipelineSpec | Mapping[str, Any]) -> dict[str, Any]:
        """Metrics with pipeline_id, status, seconds, rows and rows_per_second. An error is raised
        after the callbacks have seen it; errors of callbacks are logged. Runs that append are not tried
        again; their sinks retry what is safe to repeat."""
        spec = config if isinstance(config, PipelineSpec) else PipelineSpec.of(config)
        began, metrics = time.monotonic(), {"pipeline_id": spec.pipeline_id, "status": "success", "rows": 0}
        try:
            metrics |= retried(lambda: self._run(spec), spec.max_retries if self.repeatable(spec) else 0, spec.retry_delay)
        except Exception as e:
            metrics |= {"status": "failed", "error": str(e)}
            raise
        finally:
            metrics["seconds"] = time.monotonic() - began
            metrics["rows_per_second"] = metrics["rows"] / metrics["seconds"] if metrics["seconds"] else 0.0
            for callback in self.callbacks:
                try:
                    callback(metrics)
                except Exception as e:
                    log.warning("callback failed: %s", e)
        return metrics
