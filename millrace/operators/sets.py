"""Set operations by column name."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union_all(a: DataFrame, b: DataFrame, missing_as_null: bool = False) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=missing_as_null)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame, all_: bool = False) -> DataFrame:
    b = b.select(*a.columns)
    return a.intersectAll(b) if all_ else a.intersect(b)


def difference(a: DataFrame, b: DataFrame, all_: bool = False) -> DataFrame:
    b = b.select(*a.columns)
    return a.exceptAll(b) if all_ else a.subtract(b)
