"""What functions over Arrow batches share on a Python worker: lazy reading, and memory that goes back after each partition."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Entries of each of the two halves of a table of remembered words (about 10 MB each).
KNOWN = 65_536
#: Values of a column that are Python objects at one time.
STEP = 256


class Recent(dict):
    """What ``make`` gives for a key, remembered for the keys of late.

    When the table is full it becomes the older half and a new one begins; what is asked for again
    comes over from there, so frequent keys stay and the rest goes.
    """

    def __init__(self, make: Callable, most: int = KNOWN):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def values(column: pa.Array) -> Iterator:
    """The values of a column in order, only some of them Python objects at a time."""
    for lo in range(0, len(column), STEP):
        yield from column.slice(lo, STEP).to_pylist()


def release() -> None:
    """Gives freed memory back to the system. Idle workers live on beside those of later stages, so what they keep adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow, with its memory released at the end of the partition. What ``run`` remembers must be its own."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole
