"""Arrow plumbing: bounded slices of record batches in, record batches out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows, and bytes of strings, taken from an Arrow batch at a time; one row may be larger.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small views of the batches, so that few rows and few bytes are Python objects at once."""
    for batch in batches:
        ends = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
                ends += np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right"))
            end = min(max(most, at + 1), at + SLICE_ROWS)
            yield batch.slice(at, end - at)
            at = end


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
