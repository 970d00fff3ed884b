"""Arrow batches in pieces: Spark bounds a batch by rows alone, and Python objects of all its rows take many times its bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES, PIECE_ROWS = 2 << 20, 1024


def _sizes(column: pa.Array) -> np.ndarray:
    n = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    return pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64) * (8 if pa.types.is_list(column.type) else 1)


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """All rows in order, in slices of so many rows and bytes of the column (texts, or lists at 8 bytes an element) at most;
    a longer row stands alone."""
    for batch in batches:
        ends, at = np.cumsum(_sizes(batch.column(column))), 0
        while at < batch.num_rows:
            end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            end = max(at + 1, min(end, at + rows))
            yield batch.slice(at, end - at)
            at = end
