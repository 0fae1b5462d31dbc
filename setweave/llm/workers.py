"""Memory of Python workers, which Spark reuses: their allocators keep what a task has freed unless told to give it back."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pandas as pd


def give_back() -> None:
    """Return freed memory of Python, Arrow and the C library to the system, as far as they can."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for mapInPandas that gives memory back when its partition is done."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
