"""Objects that consecutive tasks of a Python worker share, freed soon after the last one ends."""

from __future__ import annotations

import ctypes
import gc
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa

#: Seconds without a task after which a worker frees what it kept.
IDLE = 2.0

_lock = threading.RLock()
_objects: dict = {}
_users = 0
_timer: threading.Timer | None = None


def free() -> None:
    """Drop everything that no task uses, and give the memory back to the system."""
    with _lock:
        if _users:
            return
        _objects.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its own allocator decides
        pass


@contextmanager
def kept(key, make: Callable[[], object]) -> Iterator:
    """The worker's object of that key; while a task holds it, it stays."""
    global _users, _timer
    with _lock:
        _users += 1
        if key not in _objects:
            _objects[key] = make()
        found = _objects[key]
    try:
        yield found
    finally:
        with _lock:
            _users -= 1
            if _timer is not None:
                _timer.cancel()
            _timer = threading.Timer(IDLE, free)
            _timer.daemon = True
            _timer.start()
