"""Every window of W units that occurs earlier, without shuffling every window.

Units are the bytes or the words of a document. The work goes in four steps, each linear:

1. *Anchors* (map side). Each window elects one of the named blocks inside it, by a rule that
   sees nothing but the window, so equal windows elect equal blocks. Neighbouring windows
   mostly agree; a maximal run of them is a *segment*, about one for every W/2 units or so.
   A task drops segments that it has already seen in an earlier place.
2. *Resolution*. Segments meet by the anchor's key. A segment seen before is repeated as a
   whole. The first of its kind needs a closer look only if its key has another segment.
3. *Windows*. Only for those, single windows are compared (by two 64-bit hashes of their content).
4. *Spans* are gathered by document and applied to its text.

A copied passage costs a row for a segment and task, not one for a window and document, so
neither a hot passage nor a large group of copies makes a partition much larger than others.
A document is a row's id and a hash of its text, in this order, null ids last; rows equal in both
are one document, and what is cut out of a row is never cut out of another text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import fresh, staged
from .vectext import mix, signed, slabs, span_hash, sums, utf8

LAST = (1 << 63) - 1
#: Anchors that a task holds before it compares them and passes them on.
HOLD = 1 << 19
_ANCHORS = "kind tinyint, key bigint, seg bigint, doc bigint, row bigint, start bigint, count bigint"
_SPANS = "kind tinyint, doc bigint, row bigint, start bigint, count bigint"
_WINDOWS = "kind tinyint, h0 bigint, h1 bigint, doc bigint, row bigint, start bigint, count bigint"

#: From (bytes, offsets) of a slab: unit values, row of each unit, first unit of each row (one more at the end), width.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: From (values, rows, window starts): for each window the block it elects (-1: none) and each block's span (lo, hi).
Elect = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: From (values, first units, ends) of segments: a name of each one's content.
Name = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def range_argmin(names: np.ndarray, f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Index of the least name (its high half; the leftmost of equals) in each names[f : g + 1]; -1 where empty."""
    out = np.full(len(f), -1, np.int64)
    some = g >= f
    if not len(names) or not some.any():
        return out
    table = (names & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(names), dtype=np.uint64)
    f, width = f[some], (g - f + 1)[some]
    best = np.empty(len(f), np.uint64)
    step = 1
    while True:
        here = (width >= step) & (width < 2 * step)
        if here.all():
            best = np.minimum(table[f], table[f + width - step])
        elif here.any():
            best[here] = np.minimum(table[f[here]], table[f[here] + width[here] - step])
        if not (width >= 2 * step).any():
            break
        table = np.concatenate([np.minimum(table[:-step], table[step:]), table[-step:]]) if len(table) > step else table
        step *= 2
    out[some] = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return out


def segments(values: np.ndarray, row: np.ndarray, width: int, elect: Elect, name: Name | None) -> tuple[np.ndarray, ...]:
    """Key, name of the content (0 without ``name``), first unit and number of windows of each segment of a slab."""
    n = len(values) - width + 1
    none = np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[width - 1 :]) if n > 0 else none
    if not len(at):
        return none.view(np.uint64), none.view(np.uint64), none, none
    chosen, lo, hi = elect(values, row, at)
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (chosen[1:] < 0) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    start, block = at[head], chosen[head]
    content = name(values, start, start + count + width - 1) if name else np.zeros(len(start), np.uint64)
    a, b = start.copy(), start + width
    some = block >= 0
    a[some], b[some] = lo[block[some]], hi[block[some]]
    c, inv = sums(values, 1)
    return span_hash(c, inv, a, b), content, start, count


def document(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What tells the documents of a table apart, and their order: the id, null last, and a hash of the text."""
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)), F.xxhash64(F.col(text_col).cast("string"))


def columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc, row = document(id_col, text_col)
    return docs.select(doc.alias("doc"), row.alias("row"), F.col(text_col).cast("string").alias("text"))


def _combined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Of a task's segments those that it hasn't in an earlier place (kind 1), and the others as repeated (kind 0)."""
    key, seg, doc, row, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, row, doc, key, seg))
    key, seg, doc, row, start, count = (x[order] for x in (key, seg, doc, row, start, count))
    new = np.ones(len(key), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (key[1:] != key[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    again = (doc != doc[head]) | (row != row[head]) | (start != start[head])
    # what is repeated needs no partner: neighbours become one row, and any partition will do for it
    order = np.lexsort((start[again], row[again], doc[again]))
    d, r, s, c = (x[again][order] for x in (doc, row, start, count))
    first = np.ones(len(s), bool)
    first[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (s[1:] != s[:-1] + c[:-1])
    if len(s):
        c = np.add.reduceat(c, np.flatnonzero(first))
        d, r, s = d[first], r[first], s[first]
    kind = np.concatenate([np.zeros(len(s), np.int8), np.ones(int(new.sum()), np.int8)])
    spread = mix(d.view(np.uint64) * np.uint64(31) + s.view(np.uint64))
    columns = [np.concatenate([spread, key[new]]), np.concatenate([np.zeros(len(s), np.uint64), seg[new]])]
    rest = [np.concatenate([x, y[new]]) for x, y in zip((d, r, s, c), (doc, row, start, count), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(signed(x)) for x in columns), *map(pa.array, rest)], names=["kind", "key", "seg", "doc", "row", "start", "count"])


def _anchor_rows(units: Units, elect: Elect, name: Name, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            data, offs = utf8(batch.column(2))
            doc, row = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j in slabs(offs):
                values, of, first = units(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                key, seg, start, count = segments(values, of, width, elect, name)
                if not len(key):
                    continue
                r = of[start]
                parts.append((key, seg, doc[i + r], row[i + r], start - first[r], count))
                held += len(key)
                if held >= HOLD:
                    yield _combined(parts)
                    parts, held = [], 0
        if parts:
            yield _combined(parts)

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments in the order of (key, seg, doc, row, start): repeated ones (kind 0), and firsts whose key has another segment (kind 1)."""
    state = None  # key and seg, place of the segment's first (doc, row, start, count), segments of the key so far
    names = ["kind", "doc", "row", "start", "count"]
    for batch in batches:
        kind, key, seg, *place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        out: list[list[np.ndarray]] = []

        def put(k: int, *columns: np.ndarray) -> None:
            out.append([np.full(len(columns[0]), k, np.int8), *columns])

        local = kind == 0
        put(0, *(x[local] for x in place))
        key, seg, *place = (x[~local] for x in (key, seg, *place))
        n = len(key)
        if n:
            new_key = np.ones(n, bool)
            new_key[1:] = key[1:] != key[:-1]
            new_seg = new_key.copy()
            new_seg[1:] |= seg[1:] != seg[:-1]
            goes_on = state is not None and state[0] == key[0]
            if goes_on and state[1] == seg[0]:
                new_seg[0] = False
            head = np.maximum.accumulate(np.where(new_seg, np.arange(n), -1))
            again = np.zeros(n, bool)
            for k in range(3):
                again |= place[k] != np.where(head >= 0, place[k][head], state[2][k] if state is not None else 0)
            put(0, *(x[again] for x in place))
            group = np.cumsum(new_key) - 1
            kinds = np.bincount(group, new_seg, minlength=group[-1] + 1).astype(np.int64)
            if goes_on:
                if kinds[0] and state[3] == 1:
                    put(1, *(np.array([x]) for x in state[2]))
                kinds[0] += state[3]
            look = ~again & (kinds[group] > 1)
            put(1, *(x[look] for x in place))
            first = tuple(int(x[head[-1]]) for x in place) if head[-1] >= 0 else state[2]
            state = (key[-1], seg[-1], first, kinds[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)


def _window_rows(units: Units, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each document with segments to look at (doc, row, text, places): its windows (kind 1), those that it has in an earlier place itself as kind 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            doc, row = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            places = batch.column(3)
            data, offs = utf8(batch.column(2))
            equal = np.zeros(len(doc), bool)  # equal rows are one document
            for k, own in enumerate(zip(doc.tolist(), row.tolist(), strict=True)):
                equal[k], last = own == last, own
            for i, j in slabs(offs):
                values, _, first = units(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                own = places.slice(i, j - i)
                flat = own.flatten()
                r = np.repeat(np.arange(j - i), own.value_lengths().to_numpy(zero_copy_only=False))
                start, count = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("start", "count"))
                r, start, count = (x[~equal[i + r]] for x in (r, start, count))
                start = start + first[r]
                at = np.repeat(start, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                r = np.repeat(r, count)
                hashes = [span_hash(*sums(values, k), at, at + width) for k in (0, 1)]
                pos = at - first[r]
                order = np.lexsort((pos, hashes[1], hashes[0], r))
                again = np.zeros(len(at), bool)
                o, p = order[1:], order[:-1]
                same = (r[o] == r[p]) & (hashes[0][o] == hashes[0][p]) & (hashes[1][o] == hashes[1][p])
                head = order[np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(at)), 0))] if len(at) else order
                again[order] = pos[order] != pos[head]
                yield pa.RecordBatch.from_arrays([pa.array((~again).astype(np.int8)), pa.array(signed(hashes[0])), pa.array(signed(hashes[1])), pa.array(doc[i + r]), pa.array(row[i + r]), pa.array(pos), pa.array(np.ones(len(pos), np.int64))], names=["kind", "h0", "h1", "doc", "row", "start", "count"])

    return run


def found_segments(texts: DataFrame, units: Units, elect: Elect, name: Name, width: int) -> DataFrame:
    """(kind, doc, row, start, count): repeated segments (kind 0), and those whose windows need a look (kind 1)."""
    anchors = texts.mapInArrow(_anchor_rows(units, elect, name, width), _ANCHORS)
    return staged(anchors.repartition("key").sortWithinPartitions("key", "seg", "doc", "row", "start").mapInArrow(_resolve, _SPANS), "segments")


def repeated_windows(texts: DataFrame, look: DataFrame, units: Units, width: int) -> DataFrame:
    """Of the windows in the segments ``look`` (doc, row, start, count) those that occur earlier in one of them."""
    by_row = look.groupBy("doc", "row").agg(F.collect_set(F.struct("start", "count")).alias("places"))
    windows = staged(texts.join(by_row, ["doc", "row"]).select("doc", "row", "text", "places").mapInArrow(_window_rows(units, width), _WINDOWS), "windows")
    place, found = F.struct("doc", "row", "start"), ["doc", "row", "start", "count"]
    firsts = staged(windows.filter("kind = 1").groupBy("h0", "h1").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h0", "h1", "first"), "firsts")  # written, so that the join can split a hot window
    later = windows.filter("kind = 1").join(firsts, ["h0", "h1"]).filter(place > F.col("first"))
    return windows.filter("kind = 0").select(*found).union(later.select(*found))


def repeated_spans(docs: DataFrame, units: Units, elect: Elect, name: Name, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, start, count): stretches of ``count`` windows each of which occurs earlier."""
    texts = columns(docs, id_col, text_col)
    found = found_segments(texts, units, elect, name, width)
    rest = repeated_windows(texts, found.filter("kind = 1"), units, width)
    return found.filter("kind = 0").select("doc", "row", "start", "count").union(rest)


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, out_col: str) -> DataFrame:
    """``docs`` with the stretches (start, count) of each row in ``out_col``; null where there is none."""
    d, r = fresh("doc"), fresh("row")
    doc, row = document(id_col, text_col)
    by_row = spans.groupBy(F.col("doc").alias(d), F.col("row").alias(r)).agg(F.collect_set(F.struct("start", "count")).alias(out_col))
    return docs.withColumn(d, doc).withColumn(r, row).join(by_row, [d, r], "left").select(*docs.columns, out_col)


def covered(n: int, start: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """Which of n units lie in a window of the stretches."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + count + width - 1, -1)
    return np.cumsum(step[:-1]) > 0
