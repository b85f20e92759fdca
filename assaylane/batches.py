"""Arrow batches in pieces, so that what a Python worker holds does not follow from the number of rows in a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20  # of texts that are Python objects at the same time; a longer text is alone


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``most`` bytes of a column of texts; a column of another type is one range."""
    edges = []
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        edges = (np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist()
    yield from zip([0, *edges], [*edges, len(column)], strict=True)
