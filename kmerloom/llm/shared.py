"""Tables in the shared folder, see kmerloom.tables; and what a task's process keeps."""

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

from ..tables import batches_of, dropped, new_path, shared_dir, written

__all__ = ["batches_of", "dropped", "lean", "new_path", "shared_dir", "written"]


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, after which the process gives freed memory back: it waits, with all that it holds, while stages without Python work."""

    def then_released(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return then_released
