"""Memory of Python workers, which live on between tasks and stages.

Freed memory goes back to the system, and when a worker turns to another operator the tables
of the one before are dropped.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_clearers: dict[str, Callable[[], None]] = {}
_owner: str | None = None


def register(owner: str, clear: Callable[[], None]) -> None:
    """``clear`` empties the process-wide tables of an operator."""
    _clearers[owner] = clear


def claim(owner: str) -> None:
    """Called before work on a batch: drops the tables of all other operators."""
    global _owner
    if _owner != owner:
        _owner = owner
        for name, clear in _clearers.items():
            if name != owner:
                clear()
        release()
