"""Data-quality rules, all evaluated in one pass.

Each rule is a condition that a good row meets. A row gets the names of the error rules that it fails
in _failed_rules; rows with any are invalid. Rules of severity warning never remove a row, they are
counted. A null makes most conditions unknown; null_policy says whether that fails or passes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.project import sort_key

FAILED = "_failed_rules"
#: Parts of the rows of one value of a UNIQUE column.
SALTS = 64


class Kind(Enum):
    NOT_NULL = "not_null"
    UNIQUE = "unique"
    RANGE = "range"
    PATTERN = "pattern"
    REGEX = "regex"
    ALLOWED = "allowed_values"
    IN_LIST = "in_list"
    LENGTH = "length"
    CUSTOM = "custom"


@dataclass(frozen=True)
class Rule:
    """params: min, max (range); pattern; values; min_length, max_length; order (unique); and for
    custom check: a SQL condition, or a function of the column that gives one."""

    name: str
    column: str | None
    kind: Kind | str
    params: Mapping[str, Any] = field(default_factory=dict)
    severity: str = "error"
    description: str = ""
    null_policy: str = "fail"

    def __post_init__(self) -> None:
        object.__setattr__(self, "kind", Kind(self.kind))
        if self.severity not in ("error", "warning"):
            raise ValueError(f"severity {self.severity!r}: error or warning")
        if self.null_policy not in ("fail", "pass"):
            raise ValueError(f"null policy {self.null_policy!r}: fail or pass")

    def _condition(self) -> Column:
        p, c = self.params, F.col(self.column) if self.column else None
        between = lambda x, low, high: (F.lit(True) if low is None else x >= low) & (F.lit(True) if high is None else x <= high)
        match self.kind:
            case Kind.NOT_NULL:
                return c.isNotNull()
            case Kind.RANGE:
                return between(c, p.get("min"), p.get("max"))
            case Kind.PATTERN | Kind.REGEX:
                return c.rlike(p["pattern"])
            case Kind.ALLOWED | Kind.IN_LIST:
                return c.isin(list(p["values"]))
            case Kind.LENGTH:
                return between(F.length(c), p.get("min_length"), p.get("max_length"))
            case Kind.UNIQUE:
                raise ValueError("uniqueness is no condition of one row; evaluate() sees to it")
        check: str | Callable[[Column], Column] = p["check"]
        return F.expr(check) if isinstance(check, str) else check(c)

    def passes(self) -> Column:
        """Never null."""
        return F.coalesce(self._condition(), F.lit(self.null_policy == "pass" and self.kind is not Kind.NOT_NULL))


def evaluate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """df with _failed_rules: names of the error rules a row fails, in order; and _warnings likewise.

    Of rows with one value of a UNIQUE column the first passes, by the rule's order and then by the whole
    row; null is a value."""
    columns = df.columns
    # a rule over a window cannot stand inside an array, so all come as columns first
    flags = {f"_rule_{i}": ~r.passes() for i, r in enumerate(rules) if r.kind is not Kind.UNIQUE}
    unique = [(f"_rule_{i}", r) for i, r in enumerate(rules) if r.kind is Kind.UNIQUE]
    for name, rule in unique:
        df = _repeats(df, rule, columns, name)
    names = [f"_rule_{i}" for i in range(len(rules))]
    named = lambda severity: F.array_compact(F.array(*[F.when(F.col(f"_rule_{i}"), r.name) for i, r in enumerate(rules) if r.severity == severity])).cast("array<string>")
    return df.select("*", *[c.alias(n) for n, c in flags.items()]).withColumns({FAILED: named("error"), "_warnings": named("warning")}).drop(*names)


def _repeats(df: DataFrame, rule: Rule, columns: Sequence[str], name: str) -> DataFrame:
    """df with a flag: another row of this value comes first. The rows of a value are shared out by a salt;
    the first of each salt then meet, so that no task sees all rows of a frequent value."""
    plain = [F.col(f"`{c}`") for c in columns if df.schema[c].dataType.typeName() not in ("map", "variant")]
    order = [*[sort_key(o) for o in rule.params.get("order", [])], F.xxhash64(*plain)]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
    first = salted.withColumn("_first", F.row_number().over(Window.partitionBy(rule.column, "_salt").orderBy(*order)) == 1)
    met = first.withColumn("_meets", F.when(F.col("_first"), -1).otherwise(F.col("_salt")))
    rank = F.row_number().over(Window.partitionBy(rule.column, "_meets").orderBy(*order))
    return met.withColumn(name, ~(F.col("_first") & (rank == 1))).drop("_salt", "_first", "_meets")


def split(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Valid rows with df's columns, and invalid ones with _failed_rules."""
    seen = evaluate(df, rules)
    valid = F.size(FAILED) == 0
    return seen.filter(valid).drop(FAILED, "_warnings"), seen.filter(~valid).drop("_warnings")


def with_quality_columns(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """df with failed_rules and quality_score: the share of error rules met, in per cent."""
    n = sum(r.severity == "error" for r in rules)
    score = F.lit(100.0) if not n else (1 - F.size(FAILED) / F.lit(n)) * 100.0
    return evaluate(df, rules).withColumn("quality_score", score).withColumnRenamed(FAILED, "failed_rules").drop("_warnings")


def metrics(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """total, valid, invalid, score and failures and warnings by rule, in one job; score of no rows is 0."""
    seen = evaluate(df, rules)
    total, valid = F.count(F.lit(1)), F.count_if(F.size(FAILED) == 0)
    by_rule = [F.count_if(F.array_contains(FAILED if r.severity == "error" else "_warnings", r.name)).alias(f"failed_{r.name}") for r in rules]
    return seen.agg(total.alias("total"), valid.alias("valid"), (total - valid).alias("invalid"), F.coalesce(F.try_divide(valid * 100.0, total), F.lit(0.0)).alias("score"), *by_rule)


def quarantine(invalid: DataFrame, path: str) -> None:
    """Appends invalid rows with the time to Parquet files."""
    invalid.withColumn("_quarantine_timestamp", F.current_timestamp()).write.mode("append").parquet(path)


def null_counts(required: Sequence[str]) -> list[Column]:
    """rows and nulls_ of each required column, as aggregates."""
    return [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in required]]


def check(df: DataFrame, required: Sequence[str], keys: Sequence[str] = ()) -> dict[str, int]:
    """Null counts of the required columns and repeated keys, in one job."""
    counts = null_counts(required)
    if not keys:
        return df.agg(*counts).first().asDict()
    grouped = df.groupBy(*keys).agg(*counts)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", *(f"nulls_{c}" for c in required))]
    found = grouped.agg(*sums, F.count(F.lit(1)).alias("keys")).first().asDict()
    return {k: v for k, v in found.items() if k != "keys"} | {"duplicates": found["rows"] - found["keys"]}
