"""Names in snake_case and camelCase, as Python strings and as columns.

A name breaks before a capital that follows a small letter or a digit, and before a capital that a
small letter follows, unless it is the first character. So orderID breaks once and HTTPServer too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CAPITAL, _SMALL, _SMALL_OR_DIGIT = "^[A-Z]$", "^[a-z]$", "^[a-z0-9]$"


def _breaks(before: str, here: str, after: str) -> bool:
    capital, small = "A" <= here <= "Z", lambda c: "a" <= c <= "z"
    return bool(capital and before and (small(before) or "0" <= before <= "9" or small(after)))


def snake_case(name: str) -> str:
    """Small letters, with an underscore at every break."""
    made = []
    for before, here, after in zip(["", *name], name, [*name[1:], ""], strict=False):
        made += ["_", here] if _breaks(before, here, after) else [here]
    return "".join(made).lower()


def camel_case(name: str) -> str:
    """Words between underscores run together; all but the first begin with a capital."""
    head, _, tail = name.partition("_")
    return head + "".join(map(str.capitalize, tail.split("_")))


def snake_case_column(text: Column) -> Column:
    letters = F.split(text, "")
    at = lambda k: F.coalesce(F.get(letters, k), F.lit(""))
    breaks = lambda c, k: c.rlike(_CAPITAL) & (k > 0) & (at(k - 1).rlike(_SMALL_OR_DIGIT) | at(k + 1).rlike(_SMALL))
    return F.lower(F.array_join(F.transform(letters, lambda c, k: F.when(breaks(c, k), F.concat(F.lit("_"), c)).otherwise(c)), ""))


def camel_case_column(text: Column) -> Column:
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    words = F.split(text, "_")
    return F.array_join(F.transform(words, lambda w, k: F.when(k == 0, w).otherwise(capital(w))), "")
