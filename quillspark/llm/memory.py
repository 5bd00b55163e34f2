"""Python workers outlive tasks and operators; what a task freed goes back to the system at its end."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Give unused memory back: Arrow's pool, and the C library's heap where it can be trimmed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


_held: dict[tuple, object] = {}


def hold(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` returns, once per worker while tasks of one kind follow each other."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def tidy(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """A task function that calls ``release`` when it ends.

    Unless it ``keeps`` what ``hold`` gives it, it first lets go of what tasks
    of other kinds left in the worker: vocabularies, models and caches.
    """
    def tidied(batches: Iterator) -> Iterator:
        if not keeps and _held:
            _held.clear()
            release()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
