"""Batches of texts cut so that what a task makes of one at once stays small, however long the texts are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at once, about; an item of a list counts ``ITEM`` bytes more.
PART, ITEM = 1 << 20, 256


def _bytes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def sliced(rows: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """Runs of rows (strings or lists of strings) of up to ``most`` bytes, a row at least; an empty batch as it is."""
    most = PART if most is None else most
    if pa.types.is_list(rows.type):
        items = np.append(0, np.cumsum(_bytes(rows.flatten()) + ITEM))
        lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = items[np.append(0, np.cumsum(lengths))]
    else:
        before = np.append(0, np.cumsum(_bytes(rows)))
    at = 0
    while True:
        end = max(int(np.searchsorted(before, before[at] + most, side="right")) - 1, at + 1)
        yield rows.slice(at, end - at)
        at = end
        if at >= len(rows):
            return
