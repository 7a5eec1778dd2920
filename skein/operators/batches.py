"""Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a worker turns into Python objects at once; a longer text is a piece of its own.
TEXT_BYTES = 2_000_000


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in pieces whose texts have about ``most`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64) + 1)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


#: Rows of a part whose different keys a task holds at once: some 300 MB.
PART_ROWS = 500_000


def parts_of(rows: DataFrame) -> int:
    """The number of parts of at most about PART_ROWS rows; at least one for each core. Rows are counted:
    give what a scan counts, not a join."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))
