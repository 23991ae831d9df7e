"""JSON payloads to columns, and rows to key and value of a message. Works on batches and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parse_json_columns(df: DataFrame, schema: StructType | str, value_col: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """The fields of the JSON in value_col as columns, then those of keep under a kafka_ prefix.
    Malformed JSON gives nulls."""
    parsed = F.from_json(F.col(value_col).cast("string"), schema).alias("data")
    return df.select(parsed, *[F.col(c).alias(f"kafka_{c}") for c in keep]).select("data.*", *[f"kafka_{c}" for c in keep])


def kafka_columns(df: DataFrame, key_col: str | None = None, value_cols: Sequence[str] | None = None) -> DataFrame:
    """key: key_col (or the first column) as text; value: the columns as one JSON object."""
    if key_col is not None and key_col not in df.columns:
        raise ValueError(f"no column {key_col!r}")
    return df.select(F.col(key_col or df.columns[0]).cast("string").alias("key"), F.to_json(F.struct(*(value_cols or df.columns))).alias("value"))
