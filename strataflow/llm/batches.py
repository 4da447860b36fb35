"""Arrow batches in and out of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a task works on at once.
SLICE_CHARS = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut so that the texts of a part hold about ``SLICE_CHARS``; null texts become empty.

    Only the texts of one part are strings at a time, and what a batch held goes back before the next.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, done = 0, 0
        while start < batch.num_rows:
            stop = min(int(np.searchsorted(ends, done + SLICE_CHARS)) + 1, batch.num_rows)
            part = batch.slice(start, stop - start)
            yield part, [t or "" for t in part.column(text).to_pylist()]
            start, done = stop, int(ends[stop - 1])
        del batch
        pa.default_memory_pool().release_unused()


def per_slice(df: DataFrame, work: Callable[[pa.RecordBatch, list[str]], dict], schema: str) -> DataFrame:
    """``work(part, texts)`` gives the columns of ``schema`` for each part of a batch."""

    def run(batches):
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_pydict(work(part, texts))

    return df.mapInArrow(run, schema)
