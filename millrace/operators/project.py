"""Projection steps, as functions and as a list of specs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = ("filter", "select", "rename", "cast", "drop", "with", "order", "limit", "repartition")


def apply_steps(df: DataFrame, steps: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Applies specs {type: ..., ...} in order; an unknown type is an error."""
    for step in steps:
        df = apply_step(df, step)
    return df


def apply_step(df: DataFrame, step: Mapping[str, Any]) -> DataFrame:
    match step.get("type"):
        case "filter":
            return df.filter(step["condition"])
        case "select":
            return df.selectExpr(*step["columns"])
        case "rename":
            return df.withColumnsRenamed(dict(step["mapping"]))
        case "cast":
            return cast_columns(df, step["mapping"], step.get("strict", False))
        case "drop":
            return df.drop(*step["columns"])
        case "with":
            return df.withColumns({name: F.expr(e) for name, e in step["columns"].items()})
        case "order":
            return df.orderBy(*[sort_key(c) for c in step["columns"]])
        case "limit":
            return df.limit(int(step["n"]))
        case "repartition":
            return df.repartition(*([int(step["n"])] if "n" in step else []), *step.get("columns", []))
        case other:
            raise ValueError(f"unknown step {other!r}; one of {', '.join(STEPS)}")


def sort_key(key: str | Column) -> Column:
    """An expression to sort by; text may end in ASC or DESC, or begin with - for DESC."""
    if not isinstance(key, str):
        return key
    text, _, way = key.strip().rpartition(" ")
    if way.upper() in ("ASC", "DESC") and text:
        return F.expr(text).desc() if way.upper() == "DESC" else F.expr(text).asc()
    return F.expr(key[1:]).desc() if key.startswith("-") else F.expr(key).asc()


def cast_columns(df: DataFrame, mapping: Mapping[str, str], strict: bool = False) -> DataFrame:
    """Casts; what cannot be cast becomes null, or fails the job if strict."""
    return df.withColumns({c: F.col(c).cast(t) if strict else F.col(c).try_cast(t) for c, t in mapping.items()})


def with_provenance(df: DataFrame, pipeline_id: str) -> DataFrame:
    """When and by which pipeline a row was processed; call it last, so no selection drops it."""
    return df.withColumns({"_processed_at": F.current_timestamp(), "_pipeline_id": F.lit(pipeline_id)})
