"""Arrow batches in small pieces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The batches' rows, a few at a time: what a kernel makes Python objects of does not grow with a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
