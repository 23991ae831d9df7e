"""Streams."""

from __future__ import annotations

from typing import Any

from millrace.plans.spec import PipelineSpec
from millrace.runners.base import Runner
from millrace.streaming.run import start, watch


class StreamingRunner(Runner):
    """spec.streaming: output_mode, trigger, checkpoint_location, max_runtime."""

    def _run(self, spec: PipelineSpec) -> dict[str, Any]:
        query = start(self.spark, {"pipeline_id": spec.pipeline_id, "source": spec.source, "target": spec.target, "transforms": spec.transforms} | {k: v for k, v in spec.streaming.items() if k != "max_runtime"})
        try:
            return watch(query, spec.streaming.get("max_runtime"))
        finally:
            if query.isActive:
                query.stop()
