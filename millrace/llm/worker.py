"""What a Python worker keeps between tasks: the caches of one operator at a time.

Workers are reused, and every one of them comes to serve every stage; without this, each would
in time hold the tables of all operators.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

#: Gives freed memory back to the system, in C libraries that can.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", int)
_CACHES: list[dict] = []
_OWNER: list[str] = [""]


def cache() -> dict:
    """A dictionary that is emptied when another operator takes the worker over."""
    made: dict = {}
    _CACHES.append(made)
    return made


def owns(name: str) -> None:
    """Called first in each task: the worker now serves operator ``name``."""
    if _OWNER[0] != name:
        _OWNER[0] = name
        for held in _CACHES:
            held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _trim(0)
