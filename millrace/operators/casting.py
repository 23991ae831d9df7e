"""Type casts with a stated treatment of what does not convert."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def cast(df: DataFrame, types: Mapping[str, str], on_error: str = "null") -> DataFrame:
    """null (and keep, which comes to the same): what does not convert becomes null. fail: an error
    that counts such values, from one job over all columns."""
    if on_error not in ("null", "keep", "fail"):
        raise ValueError(f"on_error {on_error!r}: null, keep or fail")
    known = {c: t for c, t in types.items() if c in df.columns}
    for c in types.keys() - known.keys():
        log.warning("no column %s to cast", c)
    if on_error == "fail" and known:
        row = conversions(df, known).first()
        if bad := {c: row[f"{c}_failed"] for c in known if row[f"{c}_failed"]}:
            raise ValueError(f"values that do not convert: {bad}")
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in known.items()})


def conversions(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """<column>_converted and <column>_failed for all columns, in one job."""
    made = []
    for c, t in types.items():
        after = F.col(c).try_cast(t)
        made += [F.count_if(after.isNotNull()).alias(f"{c}_converted"), F.count_if(F.col(c).isNotNull() & after.isNull()).alias(f"{c}_failed")]
    return df.agg(*made)
