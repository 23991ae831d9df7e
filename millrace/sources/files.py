"""Files: CSV, JSON, Parquet, ORC, text and, with its jar, Avro."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.types import schema_of

FORMATS = ("csv", "json", "parquet", "orc", "text", "avro")


def _format(spec: Mapping[str, Any], default: str) -> str:
    name = spec.get("format", default)
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}; one of {', '.join(FORMATS)}")
    return name


def _schema(spec: Mapping[str, Any]) -> StructType | str | None:
    given = spec.get("schema")
    return schema_of(given) if isinstance(given, Mapping) else given


def read(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    """path, format (parquet), schema, options. CSV has a header, and its types are inferred unless a
    schema is given: inference reads the files once more."""
    name, schema = _format(spec, "parquet"), _schema(spec)
    reader = spark.read.format(name)
    if name == "csv":
        reader = reader.options(header=True, inferSchema=schema is None)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**spec.get("options", {})).load(spec["path"])


def read_stream(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    """path, format (json), schema, options; a stream of files needs a schema, but for text."""
    name, schema = _format(spec, "json"), _schema(spec)
    if schema is None and name != "text":
        raise ValueError("a stream of files needs a schema")
    reader = spark.readStream.format(name)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**spec.get("options", {})).load(spec["path"])


def partitions(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of partition columns. Only directory names are read."""
    return df.select(*columns).distinct()


def estimate_size(spark: SparkSession, path: str) -> dict[str, float]:
    """bytes, files and mean bytes of what lies under path, hidden files left out; no file is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    row = listed.filter(~F.regexp_extract("path", "([^/]*)$", 1).rlike("^[._]")).agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    return {"bytes": row[0], "files": row[1], "mean_bytes": row[0] / row[1] if row[1] else 0.0}
