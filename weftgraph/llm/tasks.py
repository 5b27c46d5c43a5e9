"""What Python workers hold: a task's tools and memos go when the task ends.

Workers outlive tasks and are handed out in turn, so whatever one keeps stays in every idle worker of an executor beside
what the next stage needs. Compiled tools come by broadcast instead, which is cheap to load.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Return unused memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow or mapInPandas function that gives memory back when its task ends, also when it fails."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
