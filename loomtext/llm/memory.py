"""What a Python worker remembers between tasks is of one kind at a time.

Workers live on from job to job, so an operator that starts frees what another one left, and gives the
pages back to the system.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_held: dict[str, Callable[[], None]] = {}


def claim(kind: str, release: Callable[[], None] = lambda: None) -> None:
    """Free everything of other kinds, and pages that earlier tasks left; `release` will free this kind when
    another one claims. Called at the start of a task."""
    for other in [k for k in _held if k != kind]:
        _held.pop(other)()
    _held[kind] = release
    give_back()


def give_back() -> None:
    """Return freed pages to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
