"""Python workers outlive their tasks; what a task has freed goes back to the machine."""

from __future__ import annotations

import ctypes
import gc
import sys


def release() -> None:
    """Return freed memory of Arrow and of the allocator, at the end of a task or group."""
    import pyarrow as pa

    gc.collect(0)
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL("libc.so.6").malloc_trim(0)
