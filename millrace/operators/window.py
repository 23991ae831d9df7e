"""Window functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.operators.aggregate import _function

RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}


def over(partition: Sequence[str], order: Sequence[str | Column] = (), rows: tuple[int, int] | None = None, range_: tuple[int, int] | None = None) -> WindowSpec:
    """A window; without a frame the whole partition, or up to the current row's peers if ordered."""
    w = Window.partitionBy(*partition)
    if order:
        w = w.orderBy(*order)
    if rows:
        w = w.rowsBetween(*rows)
    return w.rangeBetween(*range_) if range_ else w


def window_aggregates(df: DataFrame, partition: Sequence[str], aggregates: Mapping[str, Sequence[str]], order: Sequence[str | Column] = (), rows: tuple[int, int] | None = None, range_: tuple[int, int] | None = None) -> DataFrame:
    """Adds <column>_<function>_window for {function: columns}, all over one window."""
    w = over(partition, order, rows, range_)
    # count_distinct has no window form; the size of the set is the same
    make = {"count_distinct": lambda c: F.size(F.collect_set(c).over(w)), "collect_list": lambda c: F.collect_list(c).over(w), "collect_set": lambda c: F.sort_array(F.collect_set(c).over(w))}
    return df.select("*", *[make.get(f, lambda c, f=f: _function(f)(c).over(w))(F.col(c)).alias(f"{c}_{f}_window") for f, columns in aggregates.items() for c in columns])


def ranks(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], functions: Sequence[str] = tuple(RANKS), ntile: int | None = None) -> DataFrame:
    w = over(partition, order)
    tiles = [F.ntile(ntile).over(w).alias("ntile")] if ntile else []
    return df.select("*", *[RANKS[f]().over(w).alias(f) for f in functions], *tiles)


def neighbours(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], column: str, steps: int = 1) -> DataFrame:
    """Adds <column>_lag and <column>_lead."""
    w = over(partition, order)
    return df.select("*", F.lag(column, steps).over(w).alias(f"{column}_lag"), F.lead(column, steps).over(w).alias(f"{column}_lead"))


def nth_values(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], column: str, at: Sequence[int]) -> DataFrame:
    """Adds <column>_nth<n>: the n-th value of the whole partition in the order, null if it has fewer."""
    w = over(partition, order, rows=(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.select("*", *[F.nth_value(column, n).over(w).alias(f"{column}_nth{n}") for n in at])
