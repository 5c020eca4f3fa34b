"""Arrow functions' steps, memory, lines and row spans; all loops run in C++ or numpy."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step handles; a longer single text forms a step of its own.
STEP_BYTES = 2 << 20


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that gives freed memory back at its end: workers live on between tasks, beside other stages' work."""

    @functools.wraps(run)
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return go


def byte_steps(text: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) row ranges of at most ``limit`` bytes each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def lines(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lists = pc.split_pattern(text, "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), offsets - offsets[0]


def owner(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
