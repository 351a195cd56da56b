"""Arrow batches in small pieces, so that what a text expands to is held for few texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
