"""One operator's memory at a time in a Python worker process.

Spark keeps worker processes between stages.  An operator's caches and models
are worth keeping while its tasks go on, but not beside those of the next
operator, so a process holds one of them only.  Large blocks of arrays and Arrow
batches come from the system one by one and go back to it as soon as they are
free, not into pools that keep them.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
#: Words up to this length are worth remembering; so many words bound the bytes too.
LONG_WORD = 128
_held: dict[object, object] = {}
#: glibc's number of the setting, and the size from which a block is one of its own.
_MMAP_THRESHOLD, _LARGE = -3, 2 << 20

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(_MMAP_THRESHOLD, _LARGE)
    pa.set_memory_pool(pa.system_memory_pool())
except (OSError, AttributeError):
    _libc = None


def held(key: object, make: Callable[[], T]) -> T:
    """The object of ``key``; what another key had made is dropped first."""
    if key not in _held:
        _held.clear()
        gc.collect()
        if _libc is not None:
            _libc.malloc_trim(0)
        _held[key] = make()
    return _held[key]


def forget_long(memory: dict, words: Iterable) -> None:
    """Take long ones of the words just learned out of a memory of words, so that its number of entries bounds its bytes."""
    for w in words:
        if len(w) > LONG_WORD:
            memory.pop(w, None)
