"""Keeping Python workers small: they live on between tasks, next to an executor's heap."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: What operators remember in a worker from task to task, by owner: how to forget it.
_remembered: dict[str, Callable[[], None]] = {}


def remember(owner: str, forget: Callable[[], None]) -> None:
    """An operator keeps something in this worker; it goes when another operator's task begins here."""
    _remembered[owner] = forget


def begin(owner: str = "") -> None:
    """A task of this operator begins: what the others remember goes."""
    others = [o for o in _remembered if o != owner]
    for other in others:
        _remembered.pop(other)()
    if others:
        give_back()


def give_back() -> None:
    """Returns to the system what this worker's arrays have freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable:
    """The function, which frees what other operators remember before its task and gives memory back after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        yield from function(batches)
        give_back()

    return run
