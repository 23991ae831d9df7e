"""Transforms of streams; all of them take batches as well."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.aggregate import named_metrics
from millrace.operators.dedup import deduplicate
from millrace.operators.masking import mask
from millrace.operators.project import apply_step, with_provenance
from millrace.operators.quality import Rule, split
from millrace.sources import read


def needs_batch(step: Mapping[str, Any]) -> bool:
    """Whether a step of a stream works on whole batches only: order, limit, a choice among duplicates, and
    rules of uniqueness. On a stream it holds for each batch, within foreachBatch."""
    kind = step.get("type")
    if kind == "quality":
        return any((r.kind.value if isinstance(r, Rule) else str(r.get("kind"))) == "unique" for r in step["rules"])
    return kind in ("order", "limit") or (kind == "deduplicate" and step.get("keep", "first") != "first")


def split_steps(steps: Sequence[Mapping[str, Any]]) -> tuple[list[Mapping[str, Any]], list[Mapping[str, Any]]]:
    """The steps that run on the stream, and from the first that needs whole batches on those that run on
    each batch."""
    at = next((k for k, s in enumerate(steps) if needs_batch(s)), len(steps))
    return list(steps[:at]), list(steps[at:])


def watermark(df: DataFrame, column: str, delay: str) -> DataFrame:
    """A column without a time zone becomes a timestamp in the session's."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df.withWatermark(column, delay)


def window_aggregate(df: DataFrame, column: str, duration: str, groups: Sequence[str], metrics: Sequence[Mapping[str, Any]], slide: str | None = None) -> DataFrame:
    """Tumbling, or with slide sliding, windows as window_start and window_end."""
    return named_metrics(df, groups, metrics, {"column": column, "duration": duration} | ({"slide": slide} if slide else {}))


def session_aggregate(df: DataFrame, column: str, gap: str, groups: Sequence[str], metrics: Sequence[Mapping[str, Any]]) -> DataFrame:
    made = named_metrics(df.withColumn("_session", F.session_window(column, gap)), ["_session", *groups], metrics)
    return made.select(F.col("_session.start").alias("session_start"), F.col("_session.end").alias("session_end"), *[c for c in made.columns if c != "_session"])


def stream_deduplicate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeats within the watermark go; needs watermark() before."""
    return df.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def join_static(stream: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A stream with a table that is read anew for each batch. The stream's side can be kept (left,
    left_semi, left_anti), the table's cannot."""
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"a stream and a table cannot join {how!r}")
    return stream.join(table, list(keys), how)


def join_streams(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, earliest: str, latest: str, how: str = "inner") -> DataFrame:
    """Rows of two streams with equal keys, the right one's time from earliest to latest behind the left
    one's (SQL intervals, such as '-1 hour'). Both need a watermark, so that state has an end; with how left
    a row without a partner comes out when none can come any more. Columns of right other than its
    keys must have names of their own."""
    if how not in ("inner", "left", "left_outer", "left_semi"):
        raise ValueError(f"two streams cannot join {how!r} here")
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.expr(f"`{right_time}` >= `{left_time}` + INTERVAL {earliest} AND `{right_time}` <= `{left_time}` + INTERVAL {latest}")
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def count_by_key(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    """A custom stateful operator: how many rows of each key have come so far, once a batch, by state that
    Spark keeps for each key."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {out} long"

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        yield pd.DataFrame({key: [keys[0]], out: [n]})

    return df.groupBy(key).applyInPandasWithState(update, schema, "n long", "update", GroupStateTimeout.NoTimeout)


def transform(df: DataFrame, steps: Sequence[Mapping[str, Any]], pipeline_id: str | None = None) -> DataFrame:
    """Steps {type: ...}: watermark, aggregate (window {column, duration, slide}, group_by, metrics),
    session (column, gap, group_by, metrics), join (table: a DataFrame or a source's spec, keys, how),
    deduplicate, mask, quality (valid rows go on), and those of a projection. Provenance comes last."""
    for step in steps:
        match step.get("type"):
            case "watermark":
                df = watermark(df, step["column"], step["threshold"])
            case "aggregate":
                df = named_metrics(df, step.get("group_by", []), step["metrics"], step.get("window"))
            case "session":
                df = session_aggregate(df, step["column"], step["gap"], step.get("group_by", []), step["metrics"])
            case "join":
                table = step["table"] if isinstance(step["table"], DataFrame) else read(df.sparkSession, step["table"])
                df = join_static(df, table, step["keys"], step.get("how", "inner"))
            case "deduplicate":
                df = stream_deduplicate(df, step["keys"]) if df.isStreaming else deduplicate(df, step.get("keys"), step.get("keep", "first"), step.get("order", ()), step.get("timestamp"))
            case "mask":
                df = mask(df, step["rules"])
            case "quality":
                df = split(df, [r if isinstance(r, Rule) else Rule(**r) for r in step["rules"]])[0]
            case _:
                df = apply_step(df, step)
    return with_provenance(df, pipeline_id) if pipeline_id else df
