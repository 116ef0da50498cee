"""Memory of Python workers: Spark hands a worker task after task and keeps it in between, so what tasks leave adds up."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: What a worker remembers from task to task, for tasks of the same kind.
remembered: dict[tuple, dict] = {}


def give_back() -> None:
    """Freed memory that Arrow and the C library hold in reserve goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def tidy(run: Run, remembers: bool = False) -> Run:
    """``run``, whose tasks give back their memory in the end; what earlier tasks remembered stays only if it ``remembers``."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            remembered.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
