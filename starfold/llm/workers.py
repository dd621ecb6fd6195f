"""Arrow batches and caches inside tasks."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

_held: dict[str, Callable[[], object]] = {}


def hold(owner: str, release: Callable[[], object] = lambda: None) -> None:
    """Empty what other operators keep in this worker, which outlives their tasks; ``release`` empties the caches of ``owner``."""
    others = [x for x in _held if x != owner]
    for other in others:
        _held.pop(other)()
    if others:
        gc.collect()  # vocabularies and their caches refer to each other
    _held[owner] = release


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice stay near ``limit`` bytes; one longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (total + n > limit or i - start >= rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start, len(sizes) - start)
