"""Repeats what may fail for a while."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from typing import TypeVar

log = logging.getLogger(__name__)
R = TypeVar("R")


def retried(action: Callable[[], R], retries: int = 3, delay: float = 1.0, exponential: bool = True, final: tuple[type[BaseException], ...] = (ValueError,)) -> R:
    """Calls action up to retries + 1 times; waits delay, doubled each time if exponential. Errors of
    the kinds in final are not tried again. The action must be safe to repeat."""
    for attempt in range(retries + 1):
        try:
            return action()
        except final:
            raise
        except Exception as e:
            if attempt == retries:
                raise
            log.warning("attempt %d failed: %s", attempt + 1, e)
            time.sleep(delay * 2**attempt if exponential else delay)
    raise AssertionError
