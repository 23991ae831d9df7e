"""Whole tables: read, transform, check, write. One job writes and counts."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Observation

from millrace.operators.project import with_provenance
from millrace.operators.quality import check, null_counts
from millrace.plans.spec import PipelineSpec
from millrace.runners.base import Runner, State
from millrace.sinks.base import sink_for
from millrace.sources import read
from millrace.streaming.ops import transform
from millrace.tables.store import TableStore


class BatchRunner(Runner):
    def _run(self, spec: PipelineSpec) -> dict[str, Any]:
        df = transform(read(self.spark, spec.source), spec.transforms)
        found: dict[str, Any] = {}
        rules = spec.validation
        required, keys = rules.get("required", []), rules.get("keys", [])
        counted = Observation() if rules and not keys and not rules.get("fail") and spec.target.get("mode") != "merge" else None
        if rules and counted is None:
            found = self._judged(check(df, required, keys))
            if found["validation_errors"] and rules.get("fail"):
                raise ValueError(f"data checks failed: {found['checks']}")
        # counts that need no shuffle and stop nothing come from the write; a merge may read its rows twice
        made = df if counted is None else df.observe(counted, *null_counts(required))
        if spec.provenance:
            made = with_provenance(made, spec.pipeline_id)
        written = sink_for(self.spark, spec.target).write(made)
        if counted is not None:
            # an observation ends with the first attempt: where the write was tried again, or not at all, they are counted anew
            whole = written.rows and counted.get.get("rows") == written.rows
            found = self._judged(counted.get if whole else check(df, required))
        state = State(self.spark, spec.state_path, spec.pipeline_id)
        runs = state.load().get("runs", 0) + 1
        if spec.optimize_every and runs % spec.optimize_every == 0 and spec.target.get("type", "table") in ("table", "delta"):
            store = TableStore(self.spark, spec.target["path"])
            store.optimize(spec.z_order)
            if spec.vacuum_hours is not None:
                store.vacuum(spec.vacuum_hours)
        state.save(runs=runs, rows=written.rows)
        return found | {"rows": written.rows, "status": written.status}

    @staticmethod
    def _judged(checks: dict[str, int]) -> dict[str, Any]:
        return {"checks": checks, "validation_errors": sum(v for k, v in checks.items() if k != "rows")}
