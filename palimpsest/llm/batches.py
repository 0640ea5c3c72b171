"""Helpers for operators that see texts as Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Code points of a slice of a batch that is held as one numpy array.
SLICE_CHARS = 4_000_000


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts whose joined length stays near ``limit``; one text never splits."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def codes(texts: list[str], sep: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts joined by ``sep`` (one more at the end), and where each text starts."""
    joined = sep.join(texts) + sep
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + len(sep) for t in texts], out=starts[1:])
    return flat, starts


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
