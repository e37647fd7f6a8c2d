"""Arrow batches of (key columns, text) as NumPy views, cut into pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Bytes of text that the vectorised helpers handle at once; one longer text is handled alone.
PIECE_BYTES = 1 << 20


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; null counts as the empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    at = at.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with at most ``limit`` bytes, or of one longer row."""
    data, at = text_buffers(column)
    n, row = len(at) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, end, data[at[row]:at[end]], at[row:end + 1] - at[row]
        row = end


def text_udf(make: Callable[[], Callable[[pa.Array], pa.Array]], returns: str) -> Any:
    """Column function of a text column; ``make`` builds, once for each task, what maps a batch of texts to values.

    The other columns of the rows stay in the JVM.
    """

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = make()
        for batch in texts:
            yield own(batch)

    return F.arrow_udf(run, returns)
