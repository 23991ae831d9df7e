"""Masking by rules, and tokens from a vault."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import masks
from millrace.storage import staged

log = logging.getLogger(__name__)


class Strategy(Enum):
    FULL_MASK = "full_mask"
    PARTIAL_MASK = "partial_mask"
    HASH = "hash"
    REDACT = "redact"
    TOKENIZE = "tokenize"
    FORMAT_PRESERVE = "format_preserve"
    ENCRYPT = "encrypt"
    PATTERN = "pattern"


def _strategy(rule: Mapping[str, Any]) -> Strategy:
    name = str(rule.get("strategy", "full_mask"))
    for s in Strategy:
        if name.lower() in (s.value, s.name.lower()):
            return s
    raise ValueError(f"unknown masking strategy {name!r}")


def mask_column(value: Column, rule: Mapping[str, Any]) -> Column:
    """The masked value. A partial mask takes the first of preserve_domain, visible_digits,
    preserve_area_code and visible_start / visible_end that the rule has."""
    char = rule.get("mask_char", "*")
    match _strategy(rule):
        case Strategy.FULL_MASK:
            return masks.full(value, char, rule.get("mask_length", 10), rule.get("keep_null", False))
        case Strategy.PARTIAL_MASK:
            text = value.cast("string")
            if rule.get("preserve_domain"):
                return masks.email(text, char)
            if "visible_digits" in rule:
                return masks.card(text, rule["visible_digits"], char)
            if rule.get("preserve_area_code"):
                return masks.phone(text, char)
            return masks.partial(text, rule.get("visible_start", 0), rule.get("visible_end", 0), char)
        case Strategy.HASH:
            return masks.hashed(value, rule.get("algorithm", "sha256"), rule.get("salt", ""))
        case Strategy.REDACT:
            return masks.redacted(value, rule.get("text", "[REDACTED]"))
        case Strategy.FORMAT_PRESERVE:
            return masks.format_preserving(value.cast("string"), rule.get("key", ""))
        case Strategy.ENCRYPT:
            return masks.encrypted(value, rule["encryption_key"])
        case Strategy.PATTERN:
            return masks.template(value.cast("string"), rule["pattern"])
    raise ValueError("tokens need a vault; use tokenize()")


def mask(df: DataFrame, rules: Mapping[str, Mapping[str, Any]] | Sequence[Mapping[str, Any]], strict: bool = False) -> DataFrame:
    """rules: {column: rule}, or a list of rules with a column each. A missing column is an error if
    strict, else it is left out with a warning."""
    if not isinstance(rules, Mapping):
        rules = {r["column"]: r for r in rules}
    made = {}
    for c, rule in rules.items():
        if c in df.columns:
            made[c] = mask_column(F.col(c), rule)
        elif strict:
            raise ValueError(f"no column {c!r} to mask")
        else:
            log.warning("no column %s to mask", c)
    return df.withColumns(made)


def metrics(df: DataFrame, rules: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """rows, and for each masked column the values that are there and those that the mask changes, in
    one job."""
    made = [F.count(F.lit(1)).alias("rows")]
    for c, rule in rules.items():
        if c in df.columns:
            changed = ~mask_column(F.col(c), rule).eqNullSafe(F.col(c).cast("string"))
            made += [F.count(c).alias(f"{c}_values"), F.count_if(changed).alias(f"{c}_masked")]
    return df.agg(*made)


def grow_vault(values: DataFrame, column: str, vault: DataFrame | None = None, prefix: str = "TOKEN") -> DataFrame:
    """value, token, number: the vault with tokens PREFIX_00000001, ... for values that it has not yet.

    Numbers go on in the order of values. They are dealt out by ranges: rows of each range are
    counted, and a range's numbers start behind those before it, so no task sees all values. What is
    counted and what is numbered are the same rows, written to the shared folder between."""
    new = values.select(F.col(column).cast("string").alias("value")).filter("value IS NOT NULL").distinct()
    last = 0
    if vault is not None:
        new = new.join(vault, "value", "left_anti")
        last = vault.agg(F.max("number")).first()[0] or 0
    ranged = staged(new.repartitionByRange("value").withColumn("_part", F.spark_partition_id()), "vault")  # ranges are drawn once
    counts = ranged.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    numbered = ranged.join(F.broadcast(starts), "_part").withColumn("number", F.row_number().over(Window.partitionBy("_part").orderBy("value")) + F.col("_start") + F.lit(last))
    made = numbered.select("value", F.format_string(f"{prefix}_%08d", F.col("number").cast("long")).alias("token"), F.col("number").cast("long").alias("number"))
    return made if vault is None else vault.unionByName(made)


def tokenize(df: DataFrame, column: str, vault: DataFrame) -> DataFrame:
    """column with the vault's tokens; nulls stay. The vault must have all values."""
    out = df.join(vault.select(F.col("value").alias("_value"), F.col("token").alias("_token")), F.col(column).cast("string") == F.col("_value"), "left")
    return out.withColumn(column, F.col("_token")).drop("_value", "_token")


def detokenize(df: DataFrame, column: str, vault: DataFrame) -> DataFrame:
    """The values again; what is no token of the vault stays."""
    out = df.join(vault.select(F.col("value").alias("_value"), F.col("token").alias("_token")), F.col(column) == F.col("_token"), "left")
    return out.withColumn(column, F.coalesce("_value", column)).drop("_value", "_token")
