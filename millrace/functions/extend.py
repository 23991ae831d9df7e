"""User-defined aggregates and table functions, registered for SQL and returned for the DataFrame API."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register_aggregate(spark: SparkSession, name: str, reduce: Callable[[pd.Series], Any], returns: str = "double") -> Any:
    """An aggregate of one column by a function of a pandas Series. Its groups go to Python whole, by
    Arrow, without partial sums; where built-in aggregates can say it, they are the faster way."""

    def whole(values: pd.Series) -> Any:
        return reduce(values)

    whole.__annotations__ = {"values": pd.Series, "return": float}
    made = F.pandas_udf(whole, returns, F.PandasUDFType.GROUPED_AGG)
    return spark.udf.register(name, made)


def register_table_function(spark: SparkSession, name: str, rows: Callable[..., Iterator[tuple]], returns: str) -> Any:
    """A table function: called with a row's values, it yields rows of the schema returns. In SQL it stands
    behind LATERAL."""

    class Made:
        def eval(self, *values: Any) -> Iterator[tuple]:
            yield from rows(*values)

    made = F.udtf(Made, returnType=returns)
    spark.udtf.register(name, made)
    return made
