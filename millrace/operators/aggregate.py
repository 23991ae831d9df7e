"""Grouped aggregates, pivots, hierarchies and percentiles."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "avg": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "stddev": F.stddev_samp,
    "variance": F.var_samp,
    "first": F.min,  # without an order; see _ordered
    "last": F.max,
    "collect_list": lambda c: F.sort_array(F.collect_list(c)),
    "collect_set": lambda c: F.sort_array(F.collect_set(c)),
    "count_distinct": F.count_distinct,
    "approx_count_distinct": F.approx_count_distinct,
}


def _function(name: str) -> Callable[[Column], Column]:
    if name not in FUNCTIONS:
        raise ValueError(f"unknown aggregate {name!r}; one of {', '.join(FUNCTIONS)}")
    return FUNCTIONS[name]


def _ordered(name: str, order: Sequence[str]) -> Callable[[Column], Column]:
    """first and last go by an order; without one by the value itself, so that they do not depend on how the
    rows lie."""
    if name in ("first", "last"):
        take = F.min_by if name == "first" else F.max_by
        return lambda c: take(c, F.struct(*order, c))
    return _function(name)


def measures(df: DataFrame, aggregates: Mapping[str, Sequence[str]], order: Sequence[str] = ()) -> list[Column]:
    """{function: columns} as <column>_<function>; missing columns are left out with a warning, and
    that none is left is an error."""
    found = []
    for name, columns in aggregates.items():
        make = _ordered(name, order)
        for c in [columns] if isinstance(columns, str) else columns:
            if c in df.columns:
                found.append(make(F.col(c)).alias(f"{c}_{name}"))
            else:
                log.warning("no column %s to aggregate", c)
    if not found:
        raise ValueError("nothing to aggregate")
    return found


def aggregate(df: DataFrame, groups: Sequence[str], aggregates: Mapping[str, Sequence[str]], order: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(*measures(df, aggregates, order))


def named_metrics(df: DataFrame, groups: Sequence[str], metrics: Sequence[Mapping[str, Any]], window: Mapping[str, str] | None = None) -> DataFrame:
    """metrics: {type, column, alias}; column '*' counts rows. window: {column, duration, slide?} adds
    the window's start and end to the groups."""
    made = []
    for m in metrics:
        c = F.lit(1) if m.get("column", "*") == "*" else F.col(m["column"])
        made.append(_function(m["type"])(c).alias(m.get("alias") or f"{m['column']}_{m['type']}"))
    if not window:
        return df.groupBy(*groups).agg(*made)
    w = F.window(window["column"], window["duration"], window.get("slide"))
    out = df.groupBy(w.alias("window"), *groups).agg(*made)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def pivot(df: DataFrame, groups: Sequence[str], column: str, value: str, function: str, values: Sequence[Any] | None = None) -> DataFrame:
    """One column for each value of column. Without values Spark first looks for them, in a job."""
    return df.groupBy(*groups).pivot(column, list(values) if values is not None else None).agg(_function(function)(F.col(value)))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def _present(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no columns {missing}")


def rollup(df: DataFrame, columns: Sequence[str], aggregates: Mapping[str, Sequence[str]], grouping_id: bool = False) -> DataFrame:
    """Totals along a hierarchy; grouping_id tells totals from null values."""
    _present(df, columns)
    return df.rollup(*columns).agg(*measures(df, aggregates), *([F.grouping_id().alias("grouping_id")] if grouping_id else []))


def cube(df: DataFrame, columns: Sequence[str], aggregates: Mapping[str, Sequence[str]], grouping_id: bool = False) -> DataFrame:
    _present(df, columns)
    return df.cube(*columns).agg(*measures(df, aggregates), *([F.grouping_id().alias("grouping_id")] if grouping_id else []))


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: Mapping[str, Sequence[str]]) -> DataFrame:
    every = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(*measures(df, aggregates))


def percentiles(df: DataFrame, groups: Sequence[str], column: str, at: Sequence[float], exact: bool = False) -> DataFrame:
    """<column>_p<percent> for each share, from one pass over the groups."""
    name = lambda p: f"{column}_p{f'{p * 100:.6g}'.replace('.', '_')}"
    array = F.array(*[F.lit(float(p)) for p in at])
    found = F.percentile(column, array) if exact else F.percentile_approx(column, array)
    out = df.groupBy(*groups).agg(found.alias("_p"))
    return out.select(*groups, *[F.col("_p")[i].alias(name(p)) for i, p in enumerate(at)])


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of all columns in one job, as <column>_nulls."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """total, distinct_keys and duplicates in one job; null keys count as a value."""
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct_keys")).withColumn("duplicates", F.col("total") - F.col("distinct_keys"))
