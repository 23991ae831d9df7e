"""Checks a DataFrame's schema against an expected one, and evolves it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


class Mode(Enum):
    STRICT = "strict"
    ADD_COLUMNS = "add_columns"
    EVOLVE = "evolve"


@dataclass(frozen=True)
class Difference:
    missing: list[str] = field(default_factory=list)
    extra: list[str] = field(default_factory=list)
    types: dict[str, tuple[str, str]] = field(default_factory=dict)
    order: bool = False
    nullability: list[str] = field(default_factory=list)

    def __str__(self) -> str:
        parts = [f"missing {self.missing}" if self.missing else "", f"extra {self.extra}" if self.extra else ""]
        parts += [f"{c}: expected {a}, found {b}" for c, (a, b) in self.types.items()]
        parts += ["order differs" if self.order else "", f"nullability of {self.nullability}" if self.nullability else ""]
        return "; ".join(p for p in parts if p)


def difference(expected: StructType, found: StructType) -> Difference:
    a, b = {f.name: f for f in expected}, {f.name: f for f in found}
    both = [c for c in a if c in b]
    return Difference(
        [c for c in a if c not in b],
        [c for c in b if c not in a],
        {c: (a[c].dataType.simpleString(), b[c].dataType.simpleString()) for c in both if not same_type(a[c].dataType, b[c].dataType)},
        both != [c for c in b if c in a],
        [c for c in both if a[c].nullable != b[c].nullable],
    )


def same_type(a: DataType, b: DataType) -> bool:
    """Equal but for nullability inside."""
    return a.simpleString() == b.simpleString()


def compare(expected: StructType, found: StructType, ignore_nullability: bool = False) -> bool:
    if not ignore_nullability:
        return expected == found
    return [(f.name, f.dataType.simpleString()) for f in expected] == [(f.name, f.dataType.simpleString()) for f in found]


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    return df


def validate(df: DataFrame, expected: StructType, mode: Mode | str = Mode.STRICT, required: Sequence[str] = (), ignore_nullability: bool = False) -> DataFrame:
    """STRICT: names, types, order and, unless ignored, nullability are equal. ADD_COLUMNS: all that
    is expected is there with its type, more may be. EVOLVE: adds what is missing as null and casts
    what differs, null where it does not convert; expected columns first, then the others."""
    require(df, required)
    mode = Mode(mode)
    diff = difference(expected, df.schema)
    if mode is Mode.STRICT and not compare(expected, df.schema, ignore_nullability):
        raise ValueError(f"schema differs: {diff}")
    if mode is Mode.ADD_COLUMNS and (diff.missing or diff.types):
        raise ValueError(f"schema differs: {diff}")
    if mode is not Mode.EVOLVE:
        return df
    made = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in diff.types else F.col(f.name) if f.name not in diff.missing else F.lit(None).cast(f.dataType).alias(f.name) for f in expected]
    return df.select(*made, *diff.extra)
