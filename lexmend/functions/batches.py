"""Arrow columns a few texts at a time, so that what the kernel makes of them is held for few texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

ROWS, BYTES = 64, 1 << 20


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and length of slices with up to ``ROWS`` texts and ``BYTES`` bytes; a longer text is one of its own."""
    start = held = 0
    for at, size in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if at - start == ROWS or at > start and held + size > BYTES:
            yield start, at - start
            start, held = at, 0
        held += size
    if start < len(texts):
        yield start, len(texts) - start


def by_text(f: Callable[[str], object], kind: str = "string", made: pa.DataType | None = None):
    """A column function that gives ``f`` of every text, null for null; ``kind`` and ``made`` are the type of what ``f`` returns.

    Spark's batches have up to 10,000 texts. Results leave a worker slice by slice, so it holds one
    batch of the input as Arrow and the results of a slice, however many and long the texts are.
    """

    def each(whole: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in whole:
            for some in slices(texts):
                yield pa.array([None if t is None else f(t) for t in texts.slice(*some).to_pylist()], made or pa.string())

    return F.arrow_udf(each, kind)
