"""Spans in bytes of the UTF-8 to spans in code points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from .scalar import as_column

SPANS = "array<struct<start: bigint, end: bigint>>"


def char_places(data: np.ndarray, first: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many code points of its text begin before each byte ``place`` of row ``row``; beyond a text's end, all."""
    begun = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    base = begun[first[row]]
    return begun[np.clip(first[row] + place, first[row], first[row + 1])] - base


def char_span_lists(texts: pa.Array, spans: pa.ListArray) -> pa.ListArray:
    """The spans of each text in code points, all texts of a batch at once.

    Spans are taken in their order, and none begins before all that was passed already: where one
    overlaps those before it, its start (and its end, if need be) is clipped to their furthest end.
    """
    whole = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, buffer = whole.buffers()
    first = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    lengths = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), lengths)
    flat = spans.flatten()
    ends = [pc.fill_null(flat.field(k), 0).to_numpy(zero_copy_only=False) for k in range(2)]
    both = np.stack([char_places(data, first, row, x) for x in ends], axis=1).ravel()
    # one running maximum for all texts: each text's places lie above all of the text before
    above = (first[row] + row).repeat(2)
    both = (np.maximum.accumulate(both + above) - above).reshape(-1, 2) if len(both) else both.reshape(0, 2)
    made = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), made)


def byte_spans_to_char_spans(text: Column | str, spans: Column | str) -> Column:
    """array<struct<start, end>> in code points from one in bytes, ordered by start; null lists give empty ones."""

    @arrow_udf(SPANS)
    def converted(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return char_span_lists(texts, lists)

    return converted(as_column(text), as_column(spans))
