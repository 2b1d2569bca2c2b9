"""Arrow batches in small parts, so that Python's memory follows neither Spark's batches nor the number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of text of a part at most; a longer text is a part of its own.
ROWS, BYTES = 256, 1 << 20


def small_parts(batch: pa.RecordBatch | pa.Array, text: pa.Array) -> Iterator[pa.RecordBatch | pa.Array]:
    """``batch`` in order, in parts of up to ``ROWS`` rows whose values of ``text`` have up to ``BYTES`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(ends):
        to = max(at + 1, min(at + ROWS, int(np.searchsorted(ends, before + BYTES, "right"))))
        yield batch.slice(at, to - at)
        at, before = to, int(ends[to - 1])


def records(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of ``schema``."""
    for at in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_pylist(rows[at : at + 4096], schema)
