"""Duplicates: whole rows or by key, with a stated survivor."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Keep(Enum):
    FIRST = "first"
    LAST = "last"
    LATEST = "latest_timestamp"


def deduplicate(df: DataFrame, keys: Sequence[str] | None = None, keep: Keep | str = Keep.FIRST, order: Sequence[str] = (), timestamp: str | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Without keys whole rows. FIRST and LAST go by order, and without one any row of a key stays;
    LATEST goes by timestamp, nulls last. ties break what the order leaves equal."""
    keep = Keep(keep)
    if not keys:
        return df.dropDuplicates()
    if keep is Keep.LATEST:
        if not timestamp:
            raise ValueError("the latest row needs a timestamp column")
        by = [F.col(timestamp).desc_nulls_last()]
    elif not order:
        return df.dropDuplicates(list(keys))
    else:
        by = [F.col(c).asc() if keep is Keep.FIRST else F.col(c).desc() for c in order]
    return top_per_group(df, keys, [*by, *[F.col(c).asc() for c in ties]], 1)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key. Spark cuts groups to n before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
