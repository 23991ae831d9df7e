"""Pipelines as a chain of calls: sources by name, transforms, sinks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.sinks.base import Metrics, Sink, sink_for
from millrace.sources import read
from millrace.streaming.ops import transform

Step = Callable[[DataFrame], DataFrame] | Mapping[str, Any]


class Pipeline:
    """add_source, add_transformer, add_sink, run. All stays lazy until run() writes: one job for each
    sink, which counts its rows itself. With several sinks persist() computes the rows once."""

    def __init__(self, spark: SparkSession, name: str = "pipeline") -> None:
        self.spark, self.name = spark, name
        self.sources: dict[str, DataFrame | Mapping[str, Any]] = {}
        self.steps: list[Step] = []
        self.sinks: list[Sink] = []
        self.combine: Callable[[dict[str, DataFrame]], DataFrame] | None = None
        self.callbacks: list[Callable[[list[Metrics]], None]] = []
        self.persisted = False

    def add_source(self, source: DataFrame | Mapping[str, Any], name: str | None = None) -> Pipeline:
        self.sources[name or f"source{len(self.sources)}"] = source
        return self

    def combine_with(self, combine: Callable[[dict[str, DataFrame]], DataFrame]) -> Pipeline:
        """Makes one DataFrame of several sources."""
        self.combine = combine
        return self

    def add_transformer(self, *steps: Step) -> Pipeline:
        self.steps += steps
        return self

    def add_sink(self, sink: Sink | Mapping[str, Any]) -> Pipeline:
        self.sinks.append(sink if isinstance(sink, Sink) else sink_for(self.spark, sink))
        return self

    def on_completion(self, callback: Callable[[list[Metrics]], None]) -> Pipeline:
        self.callbacks.append(callback)
        return self

    def persist(self) -> Pipeline:
        self.persisted = True
        return self

    def plan(self) -> DataFrame:
        """The lazy result of sources and transforms."""
        frames = {n: s if isinstance(s, DataFrame) else read(self.spark, s) for n, s in self.sources.items()}
        if not frames:
            raise ValueError("no source")
        if self.combine:
            df = self.combine(frames)
        elif len(frames) == 1:
            df = next(iter(frames.values()))
        else:
            raise ValueError("several sources need combine_with")
        for step in self.steps:
            df = step(df) if callable(step) else transform(df, [step])
        return df

    def run(self) -> list[Metrics]:
        df = self.plan()
        if self.persisted:
            df = df.persist()
        try:
            results = [sink.write(df) for sink in self.sinks]
        finally:
            if self.persisted:
                df.unpersist()
        for callback in self.callbacks:
            callback(results)
        return results


def checked(steps: Sequence[Mapping[str, Any]], required: Mapping[str, Sequence[str]]) -> list[str]:
    """What the steps lack: names of missing entries by step."""
    return [f"step {i} ({s.get('type')}): {k}" for i, s in enumerate(steps) for k in required.get(s.get("type", ""), ()) if k not in s]
