"""What a Python worker keeps between tasks: one memo at a time, given up when another operator needs the memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable

import pyarrow as pa

_HELD: dict[Hashable, object] = {}


def release() -> None:
    """Drop what is held and give free memory back to the system."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def held[T](key: Hashable, make: Callable[[], T]) -> T:
    """The object of ``key``, made anew if another is held."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]  # type: ignore[return-value]
