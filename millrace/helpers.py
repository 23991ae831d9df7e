"""Small things that pipelines need on the driver."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import islice
from pathlib import Path
from typing import TypeVar

R = TypeVar("R")


def chunked(items: Iterable[R], size: int) -> Iterator[list[R]]:
    """Lists of size items; the last may be shorter."""
    if size < 1:
        raise ValueError("chunks need a size of one or more")
    rest = iter(items)
    while part := list(islice(rest, size)):
        yield part


def check_keys(given: Mapping[str, object], required: Sequence[str], optional: Sequence[str] | None = None) -> list[str]:
    """The required keys that are missing; with optional, keys that are neither are an error."""
    if optional is not None and (unknown := sorted(set(given) - set(required) - set(optional))):
        raise ValueError(f"unknown keys {unknown}")
    return [k for k in required if k not in given]


def ensure_folder(path: str | Path) -> Path:
    folder = Path(path)
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def logger(name: str = "millrace", level: int | str = "INFO") -> logging.Logger:
    """A logger that writes time, level, name and message to standard error, set up once."""
    found = logging.getLogger(name)
    found.setLevel(level)
    if not found.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        found.addHandler(handler)
    return found


def deduplicated(rows: Iterable[Mapping[str, object]], key: str) -> list[Mapping[str, object]]:
    """The first of the rows of each value of key, in their order; for lists on the driver. Rows without
    the key are of one value. Tables go through millrace.operators.dedup."""
    first: dict[object, Mapping[str, object]] = {}
    for row in rows:
        first.setdefault(row.get(key), row)
    return list(first.values())
