"""A pipeline's spec, checked when it is made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


@dataclass
class PipelineSpec:
    """source and target: specs of millrace.sources and millrace.sinks. transforms: steps in order.
    validation: {required, keys, fail}. mode: batch, incremental or streaming."""

    pipeline_id: str
    source: dict[str, Any]
    target: dict[str, Any]
    transforms: list[dict[str, Any]] = field(default_factory=list)
    validation: dict[str, Any] = field(default_factory=dict)
    mode: str = "batch"
    incremental: dict[str, Any] = field(default_factory=dict)
    streaming: dict[str, Any] = field(default_factory=dict)
    state_path: str | None = None
    provenance: bool = False
    optimize_every: int = 0
    z_order: list[str] = field(default_factory=list)
    vacuum_hours: float | None = None
    max_retries: int = 0
    retry_delay: float = 1.0

    def __post_init__(self) -> None:
        if self.mode not in ("batch", "incremental", "streaming"):
            raise ValueError(f"unknown mode {self.mode!r}; batch, incremental or streaming")
        for name in ("pipeline_id", "source", "target"):
            if not getattr(self, name):
                raise ValueError(f"a pipeline needs {name}")

    @classmethod
    def of(cls, config: Mapping[str, Any]) -> PipelineSpec:
        """From a dictionary; unknown and missing entries are errors."""
        known = cls.__dataclass_fields__
        if unknown := sorted(set(config) - set(known)):
            raise ValueError(f"unknown entries {unknown}")
        if missing := [k for k in ("pipeline_id", "source", "target") if not config.get(k)]:
            raise ValueError(f"a pipeline needs {', '.join(missing)}")
        return cls(**config)
